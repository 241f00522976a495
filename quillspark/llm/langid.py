"""Language identification: script ranges narrow the candidates, Viterbi with a switching penalty labels the words.

A word is a maximal run of letters. Its score for a language is the sum of log probabilities of its letters' trigrams
(the letter, its neighbours, a mark at word ends), learned from labelled documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import held_out, sampled

#: Trigrams are hashed to so many buckets.
BUCKETS = 1 << 16
#: First code points of script blocks, coarse: Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic, Indic and other
#: South Asian, Georgian, Hangul Jamo, Ethiopic and further, Latin additional, Greek extended, general, kana, Hangul, Han...
SCRIPT_STARTS = (0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0E00, 0x0F00, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x10000, 0x20000)
SCRIPT_NAMES = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 0, 1, 13, 14, 14, 15, 15, 16, 11, 11, 15, 17, 18, 15)
SCRIPTS = max(SCRIPT_NAMES) + 1
#: Words of one step of the two-level Viterbi; letters scored at once; cells of its tables (segments x labels x labels) at once.
SEGMENT, CHUNK, CELLS = 64, 400_000, 8_000_000
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _words(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Trigram bucket and script of each letter, first letter of each word, and the words' texts, of joined texts."""
    cp = np.frombuffer("\n".join(t.lower() for t in texts).encode("utf-32-le") + b"\n\0\0\0", dtype="<u4")
    letter = _letters()[cp]
    x = np.where(letter, cp, 0)
    before, after = np.concatenate([[0], x[:-1]]).astype(np.uint32), np.concatenate([x[1:], [0]]).astype(np.uint32)
    with np.errstate(over="ignore"):
        h = before * np.uint32(0x9E3779B1) ^ x.astype(np.uint32) * np.uint32(0x85EBCA77) ^ after * np.uint32(0xC2B2AE3D)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    at = np.flatnonzero(letter)
    first = np.flatnonzero(before[at] == 0)
    script = np.array(SCRIPT_NAMES)[np.searchsorted(SCRIPT_STARTS, cp[at[first]], side="right") - 1]
    ends = np.cumsum([len(t.lower()) + 1 for t in texts])
    return (h >> np.uint32(16))[at].astype(np.int64), script, first, np.searchsorted(ends, at[first], side="right")


def fit(docs: DataFrame, a_language: int = 1500, smoothing: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, log probabilities (BUCKETS x names) and the scripts of each, from text and non-null lang.

    Learns from about `a_language` documents of each label, outside the held-out fold and chosen by a hash of the id.
    Trigrams are counted in Spark; at most BUCKETS counts a language reach the driver, and the model has 256 KB a
    language. Null texts and labels teach nothing, null ids are one id, repeated rows count each; from an empty table
    nothing is learned and every text is `und`."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = rows.groupBy(F.col("lang").cast("string").alias("lang")).count().collect()
    names = sorted(r["lang"] for r in counts)
    if not names:
        return [], np.zeros((BUCKETS, 0), np.float32), np.zeros((SCRIPTS, 0), bool)
    pick = None
    for r in counts:
        one = (F.col("lang").cast("string") == r["lang"]) & sampled(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), a_language / r["count"])
        pick = one if pick is None else pick | one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                bucket, script, _, _ = _words([text.as_py()])
                sums = total.setdefault(lang, np.zeros(BUCKETS + SCRIPTS, np.int64))
                sums[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                sums[BUCKETS:] += np.bincount(script, minlength=SCRIPTS)
        for lang, sums in total.items():
            k = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k, pa.int32()), pa.array(sums[k], pa.int64())], names=["lang", "bucket", "n"])

    got = rows.filter(pick).select(F.col("lang").cast("string"), "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((BUCKETS + SCRIPTS, len(names)))
    table[got["bucket"].to_numpy(dtype=int), [names.index(x) for x in got["lang"]]] = got["n"].to_numpy(dtype=float)
    n, script = table[:BUCKETS] + smoothing, table[BUCKETS:]
    used = max(1, int((table[:BUCKETS].sum(1) > 0).sum()))
    logs = np.log(n / (table[:BUCKETS].sum(0) + smoothing * used))
    return names, logs.astype(np.float32), script >= 0.01 * np.maximum(script.sum(0), 1)


def viterbi(scores: np.ndarray, doc: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word (rows of `scores`) where changing the label inside a document costs `penalty`.

    Exact, in two levels: segments of SEGMENT words first give their best score from each label before to each label
    at their end, all segments at once; documents then run over segments, and segments are traced back at once."""
    n, k = scores.shape
    start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    place = np.arange(n) - np.repeat(start, np.diff(np.r_[start, n]))
    head = np.flatnonzero(place % SEGMENT == 0)
    size = np.diff(np.r_[head, n])
    order = np.argsort(-size, kind="stable")
    alive = [int((size > t).sum()) for t in range(int(size.max()))]
    eye = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)

    def step(d, t, m):
        e = scores[head[order[:m]] + t]
        return np.maximum(d, d.max(-1, keepdims=True) - penalty) + (e[:, None, :] if d.ndim == 3 else e)

    whole = np.broadcast_to(eye, (len(head), k, k)).copy()  # from label (axis 1) to label (axis 2)
    for t, m in enumerate(alive):
        whole[:m] = step(whole[:m], t, m)
    trans = np.empty_like(whole)
    trans[order] = whole
    # documents over their segments
    seg_doc = doc[head]
    first = np.flatnonzero(np.r_[True, seg_doc[1:] != seg_doc[:-1]])
    many = np.diff(np.r_[first, len(head)])
    by = np.argsort(-many, kind="stable")
    enter, best = np.empty((len(head), k)), np.zeros((len(by), k))
    for t in range(int(many.max())):
        m = int((many > t).sum())
        s = first[by[:m]] + t
        enter[s] = best[:m]
        best[:m] = (best[:m, :, None] + trans[s]).max(1)
    # forward again inside segments, now from what enters them, with back pointers
    d, back = enter[order].copy(), np.empty((len(alive), len(head), k), np.int8 if k < 128 else np.int32)
    for t, m in enumerate(alive):
        top = d[:m].argmax(-1)
        switch = d[:m].max(-1, keepdims=True) - penalty > d[:m]
        back[t, :m] = np.where(switch, top[:, None], np.arange(k))
        d[:m] = step(d[:m], t, m)
    # back over segments of each document, then inside all of them
    rank = np.empty(len(head), int)
    rank[order] = np.arange(len(head))
    out, last = np.empty(n, int), np.empty(len(head), int)
    state = best.argmax(-1)
    for t in range(int(many.max()) - 1, -1, -1):
        m = int((many > t).sum())
        s = first[by[:m]] + t
        last[s] = state[:m]
        state[:m] = (enter[s] + trans[s, :, :][np.arange(m), :, state[:m]]).argmax(-1)
    now = last[order]
    for t in range(len(alive) - 1, -1, -1):
        m = alive[t]
        out[head[order[:m]] + t] = now[:m]
        now[:m] = back[t, rank[order[:m]], now[:m]]
    return out


class Labeller:
    def __init__(self, model, penalty: float):
        self.names, self.logs, self.scripts = model
        self.penalty = penalty

    def label(self, texts: list[str]):
        """For each text: label, score, and spans (first word, end word, label)."""
        bucket, script, first, doc = _words(texts)
        out = [(UNKNOWN, 0.0, [])] * len(texts)
        if not len(first) or not self.names:
            return out
        letters = np.diff(np.r_[first, len(bucket)])
        scores = np.add.reduceat(self.logs[bucket], first, axis=0).astype(np.float64)
        candidate = self.scripts[script]
        candidate[~candidate.any(1)] = True  # a script that no language was learned in leaves all
        scores = np.where(candidate, scores, scores.min(1, keepdims=True) - 100.0)
        head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        size = np.diff(np.r_[head, len(doc)])
        row = np.repeat(np.arange(len(head)), size)
        path = np.empty(len(doc), int)
        # each text has every language that the script of one of its words allows; texts with the same ones go together
        sets, which = np.unique(np.logical_or.reduceat(candidate, head, axis=0), axis=0, return_inverse=True)
        for s, allowed in enumerate(sets):
            own, some = np.flatnonzero(allowed), np.flatnonzero(which.ravel() == s)
            part = np.cumsum(-(-size[some] // SEGMENT)) * len(own) ** 2 // CELLS
            for k in np.unique(part):
                at = np.flatnonzero(np.isin(row, some[part == k]))
                path[at] = own[viterbi(scores[np.ix_(at, own)], doc[at], self.penalty)]
        share = np.zeros((len(head), len(self.names)))
        np.add.at(share, (row, path), letters)
        top = share.argmax(1)
        change = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])])
        ends = np.r_[change[1:], len(path)]
        spans: dict[int, list] = {}
        for a, b in zip(change, ends):
            spans.setdefault(int(row[a]), []).append((int(a - head[row[a]]), int(b - head[row[a]]), self.names[path[a]]))
        for i, d in enumerate(doc[head]):
            out[d] = self.names[top[i]], float(share[i, top[i]] / share[i].sum()), spans[i]
        return out


def identify(docs: DataFrame, model, penalty: float = 12.0, with_spans: bool = True) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans (words from, to, lang) of every whole text.

    lang_pred labels most letters on the best path, score is its share of them. A text that is null or has no letter,
    and every text if no label was learned, gets `und` and 0. Texts are labelled apart, so equal rows get equal
    results and a null id is only not held out. An empty table gives no rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model, penalty)
        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1), 0
            while at < len(ids):
                some, size, begin = [], 0, at
                while at < len(ids) and (not some or size < CHUNK):
                    some.append(texts[at].as_py() or "")
                    size += len(some[-1])
                    at += 1
                got = labeller.label(some)
                columns = [ids.slice(begin, at - begin), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
                if with_spans:
                    columns.append(pa.array([[{"from": a, "to": b, "lang": x} for a, b, x in g[2]] for g in got], pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "spans"][: len(columns)])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, lang_pred string, score double" + ", spans array<struct<from: int, to: int, lang: string>>" * with_spans
    out = docs.select("doc_id", "text").mapInArrow(run, schema)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", *["spans"] * with_spans)
