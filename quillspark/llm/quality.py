"""Quality rules: text statistics, and decision lists learned from labelled statistics by sequential covering."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import held_out, sampled

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
NOT_FIRST = bytes(range(0x80, 0xC0))
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks", "n_twins")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    seen, twice = set(), set()
    for w in windows:
        if w in seen:
            twice.add(w)
        else:
            seen.add(w)
    if not twice:
        return 0
    hit = np.zeros(len(words), bool)
    at = np.fromiter((w in twice for w in windows), bool, len(windows))
    for k in range(3):
        hit[k : k + len(at)] |= at
    return int(hit.sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The values of STATS; all 0 for a null or empty text."""
    b = (text or "").encode()
    words = b.split()
    lines = [x for x in b.split(b"\n") if not x.isspace() and x]
    less = lambda s: len(b) - len(b.translate(None, s))
    return (
        len(words), len(b.translate(None, SPACE + NOT_FIRST)), less(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), len(set(words)), less(UPPER), less(DIGITS), less(b"!?"), sum(x == y for x, y in zip(words, words[1:])),
    )


def with_stats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and STATS of every document, over whole texts."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_stats(x.as_py()) for x in batch.column(len(keep))]
            columns = list(zip(*rows)) if rows else [()] * len(STATS)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(c, pa.int64()) for c in columns)], names=[*keep, *STATS])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), *(f"{s} long" for s in STATS)])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def ratios() -> dict[str, Column]:
    """What conditions are about; 0 where there are no words."""
    c = F.col
    words, chars, lines = (F.greatest(c(x), F.lit(1)).cast("double") for x in ("n_words", "word_chars", "n_lines"))
    return {
        "mean_word_chars": c("word_chars") / words, "symbols_a_word": c("n_symbols") / words, "repeat_share": c("n_repeat_words") / words,
        "dup_line_share": c("n_dup_lines") / lines, "distinct_share": c("n_distinct") / words, "upper_share": c("n_upper") / chars,
        "digit_share": c("n_digits") / chars, "marks_a_word": c("n_marks") / words, "twin_share": c("n_twins") / words, "words_a_line": c("n_words") / lines,
    }


def learn_list(x: np.ndarray, bad: np.ndarray, names: list[str], conditions: int = 4, cuts: int = 64, rules: int = 24, precision: float = 0.9, seed: int = 7) -> list[list[tuple[str, str, float]]]:
    """Sequential covering: rules for `bad` rows, each a conjunction of (name, '<=' or '>', threshold).

    Each rule grows on two thirds of the rows left, by FOIL gain over thresholds at quantiles, loses final conditions
    while that helps on the other third, and is kept if it is right there `precision` of the time. Rows it covers go."""
    rng = np.random.default_rng(seed)
    x, bad, out = x.astype(float), bad.astype(bool), []
    thresholds = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts))) if len(x) else [] for j in range(len(names))]
    while len(out) < rules and bad.sum() >= 4:
        grow = rng.random(len(x)) < 2 / 3
        rule, inside = [], grow.copy()
        while len(rule) < conditions and (inside & ~bad).any():
            p, n = (inside & bad).sum(), (inside & ~bad).sum()
            if not p:
                break
            before, best = math.log2(p / (p + n)), (1e-9, None, None)
            for j, name in enumerate(names):
                for t in thresholds[j]:
                    low = x[:, j] <= t
                    for sign, mask in (("<=", inside & low), (">", inside & ~low)):
                        if a := int((mask & bad).sum()):
                            gain = a * (math.log2(a / mask.sum()) - before)
                            if gain > best[0]:
                                best = gain, (name, sign, float(t)), mask
            if best[1] is None:
                break
            name, sign, t = best[1]
            v = x[:, names.index(name)]
            # halfway to the next value that the rows have, not at its edge
            rule.append((name, sign, float((v[v <= t].max() + v[v > t].min()) / 2) if (v > t).any() and (v <= t).any() else t))
            inside = best[2]
        value, length = max(((_worth(x[~grow], bad[~grow], names, rule[:k]), -k) for k in range(1, len(rule) + 1)), default=(0, 0))
        rule = rule[: -length]
        covered = covers(x, names, rule)
        if not rule or (covered & ~grow & bad).sum() < precision * max(1, (covered & ~grow).sum()) or (covered & bad).sum() < precision * covered.sum():
            break
        out.append(rule)
        x, bad = x[~covered], bad[~covered]
    return out


def covers(x: np.ndarray, names: list[str], rule: list[tuple[str, str, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, sign, t in rule:
        v = x[:, names.index(name)]
        out &= v <= t if sign == "<=" else v > t
    return out


def _worth(x, bad, names, rule) -> float:
    inside = covers(x, names, rule)
    p, n = (inside & bad).sum(), (inside & ~bad).sum()
    return float((p - n) / max(1, p + n))


def fit_rules(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> list[list[tuple[str, str, float]]]:
    """A decision list for quality 0, from at most about `most` labelled rows outside the held-out fold.

    Those rows are chosen by a hash of their id; their number is known before they are broadcast, and only their
    ratios reach the driver. Without labels the list is empty."""
    rows = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("label_id"), "quality")
    n = rows.count()
    if not n:
        return []
    picked = F.broadcast(rows.filter(sampled(F.col("label_id"), most / n)))
    some = docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("label_id")).select("quality", "text")
    named = ratios()
    pdf = with_stats(some, ("quality",)).select("quality", *[v.alias(k) for k, v in named.items()]).toPandas()
    pdf = pdf.sort_values(list(pdf.columns))  # the same split at every run
    return learn_list(pdf[list(named)].to_numpy(), pdf["quality"].to_numpy() == 0, list(named))


def verdict(rules: list[list[tuple[str, str, float]]]) -> Column:
    """The list as one ordered conditional expression: false at the first rule that holds, else true."""
    named, out = ratios(), None
    for rule in rules:
        hold = None
        for name, sign, t in rule:
            one = named[name] <= F.lit(t) if sign == "<=" else named[name] > F.lit(t)
            hold = one if hold is None else hold & one
        out = F.when(hold, F.lit(False)) if out is None else out.when(hold, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[list[tuple[str, str, float]]], least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """Every document's STATS, base_failed and kept.

    base_failed: under `least_words` words, or over `most_repeated` % of them in repeated 3-word windows. kept: not
    base_failed, and no rule holds. Null and empty texts have no words and so fail; equal rows get equal results; an
    empty table gives none; other columns are ignored."""
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    out = with_stats(docs).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))
