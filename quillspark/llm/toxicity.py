"""Toxicity: a weighted finite-state grammar over word classes, scored by clause.

A clause's words become class symbols (slur, intensifier, actor, modal, violence, target, negation, report, quote,
word). Five small transducers are composed into one automaton, which rewrites and weighs the symbols: the first makes
insults of slurs, the second threats of verbs of violence in their frame, then come negation, reported speech and
targets before or after. What a clause scores depends on how its words stand together. Slurs and their weights are
learned from labels."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import held_out, remove, sampled, written

#: Word lists of the grammar, in English, French, German and Spanish. A trailing * stands for any ending.
VIOLENCE = "kill* murder* hurt strangle* tuer* massacrer* frapper* töten umbringen verprügel* matar* golpear*".split()
ACTORS = "i we ich wir je nous yo nosotros".split()
MODALS = "will i'll we'll shall must should gonna going werde werden soll sollte vais allons dois devrait voy vamos debo debería".split()
INTENSIFIERS = "so such very really total complete fucking damn stupid sehr so total völlig verdammt très si vraiment tellement muy tan realmente total maldito".split()
TARGETS = "you your yours u he she they them him her people tu vous toi ils elle du dich dir euch sie ihr tú usted ustedes vosotros ellos".split()
NEGATIONS = "not no never isn't aren't wasn't don't pas jamais nicht kein keine nie nunca jamás".split()
REPORTS = "said says say called calls wrote quoted claimed dit disait sagte sagt nannte dijo dice llamó".split()
CLAUSE_ENDS = ".!?;:\n"
CLAUSE_END = re.compile(f"[{CLAUSE_ENDS}]")
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”«»„]")
#: Symbols that count when nothing weakens them, and all that a transducer after the first two can read.
HITS = ("insult", "strong insult", "threat", "violence")
SYMBOLS = ("word", "target", "negation", "report", "quote", *HITS)
#: Weights of the symbols that the composed transducers write; "aimed" adds what a target after a hit is worth.
WEIGHTS = {"insult": 1.0, "strong insult": 1.1, "threat": 0.75, "violence": 0.25, "denied": 0.3, "reported": 0.5}
WEIGHTS |= {"insult+target": 1.25, "strong insult+target": 1.35, "threat+target": 1.5, "violence+target": 1.5, "aimed insult": 0.25, "aimed strong insult": 0.25, "aimed threat": 0.75, "aimed violence": 1.25}
FEATURES = 4


@dataclass
class Transducer:
    """Deterministic: (state, symbol) -> (state, symbol written). Missing arcs copy the symbol and keep the state."""

    arcs: dict[tuple[int, str], tuple[int, str]]
    start: int = 0

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol))


@dataclass
class Composed:
    """What the second writes when it reads what the first writes; states are pairs."""

    first: Transducer | Composed
    second: Transducer
    start: tuple = field(init=False)

    def __post_init__(self):
        self.start = (self.first.start, self.second.start)
        self.memo = {}

    def step(self, state, symbol):
        got = self.memo.get((state, symbol))
        if got is None:
            a, middle = self.first.step(state[0], symbol)
            b, out = self.second.step(state[1], middle)
            got = self.memo[state, symbol] = (a, b), out
        return got


def insults() -> Transducer:
    """Makes an insult of a slur, a strong one right after an intensifier."""
    arcs = {(s, "intensifier"): (1, "word") for s in (0, 1)} | {(0, "slur"): (0, "insult"), (1, "slur"): (0, "strong insult")}
    return Transducer(arcs | {(1, x): (0, x) for x in ("word", "actor", "modal", "violence", "target", "negation", "report", "quote")})


def threats() -> Transducer:
    """Makes a threat of a verb of violence after a modal; without one it is violence. An actor alone changes nothing
    but is what the modal may follow, and the frame ends with the verb or a verb of saying."""
    arcs = {(s, "actor"): (s, "word") for s in (0, 1)} | {(s, "modal"): (1, "word") for s in (0, 1)}
    arcs |= {(0, "violence"): (0, "violence"), (1, "violence"): (0, "threat"), (1, "report"): (0, "report")}
    return Transducer(arcs)


def negation(reach: int = 3) -> Transducer:
    """Denies an insult or threat within `reach` words after a negation."""
    arcs = {(s, "negation"): (reach, "word") for s in range(reach + 1)}
    for s in range(1, reach + 1):
        arcs |= {(s, x): (s - 1, "denied" if x in HITS else x) for x in SYMBOLS if x != "negation"}
    return Transducer(arcs)


def reported() -> Transducer:
    """Marks what follows a verb of saying, or stands between quotation marks, to the end of the clause or quotation."""
    arcs = {(0, "report"): (1, "word"), (0, "quote"): (2, "word"), (1, "quote"): (2, "word"), (2, "quote"): (0, "word"), (1, "report"): (1, "word"), (2, "report"): (2, "word")}
    arcs |= {(s, x): (s, "reported") for s in (1, 2) for x in (*HITS, "denied")}
    return Transducer(arcs)


def targets() -> Transducer:
    """Strengthens a hit that follows a target in its clause, and at a target the last hit that none precedes."""
    arcs = {(0, "target"): (1, "word"), (1, "target"): (1, "word")}
    arcs |= {(1, x): (1, f"{x}+target") for x in HITS}
    arcs |= {(s, x): (x, x) for s in (0, *HITS) for x in HITS}
    arcs |= {(x, "target"): (1, f"aimed {x}") for x in HITS}
    return Transducer(arcs)


def grammar() -> Composed:
    return Composed(Composed(Composed(Composed(insults(), threats()), negation()), reported()), targets())


class Scorer:
    """Finds entries of the lexicon in a text and scores the clauses that hold one."""

    def __init__(self, lexicon: dict[str, float]):
        self.exact, self.stems = {}, {}
        for x in VIOLENCE:
            (self.stems if x.endswith("*") else self.exact)[x.rstrip("*")] = ("violence", 1.0)
        for x, w in lexicon.items():
            (self.stems if x.endswith("*") else self.exact)[x.rstrip("*")] = ("slur", w)
        self.lengths = sorted({len(x) for x in self.stems})
        for kind, words in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("actor", ACTORS), ("modal", MODALS), ("intensifier", INTENSIFIERS)):
            self.exact |= {x: (kind, 0.0) for x in words if x not in self.exact}
        self.exact |= {x: ("quote", 0.0) for x in '"“”«»„'}
        self.finder = ahocorasick.Automaton()
        for x in {x for x, (k, _) in {**self.exact, **self.stems}.items() if k in ("slur", "violence")}:
            self.finder.add_word(x, len(x))
        self.finder.make_automaton()
        self.grammar = grammar()

    def of(self, word: str) -> tuple[str, float]:
        if got := self.exact.get(word):
            return got
        for n in self.lengths:
            if got := self.stems.get(word[:n]):
                return got
        return "word", 0.0

    def features(self, text: str) -> tuple[float, ...]:
        """Sum and maximum of clause scores, matches denied or reported, share of clauses that match; zeros if none."""
        low = text.lower()
        starts = {end - n + 1 for end, n in self.finder.iter(low)}
        if not starts:
            return (0.0,) * FEATURES
        total = most = weak = 0.0
        matched, done = 0, -1
        for at in sorted(starts):
            if at < done:
                continue
            # the clause holds no earlier match, so it begins after the last one's
            begin = max(done, 0, *(low.rfind(c, max(done, 0), at) + 1 for c in CLAUSE_ENDS))
            stop = CLAUSE_END.search(low, at)
            done = stop.start() if stop else len(low)
            state, score, last = self.grammar.start, 0.0, 0.0
            for word in TOKEN.findall(low, begin, done):
                kind, weight = self.of(word)
                state, wrote = self.grammar.step(state, kind)
                last = weight or last  # what a target after it aims
                if w := WEIGHTS.get(wrote):
                    score += w * last
                    weak += wrote in ("denied", "reported")
            total, most, matched = total + score, max(most, score), matched + (score > 0)
        return math.log1p(total), most, math.log1p(weak), math.log1p(matched)


def _some(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    n = rows.count()
    picked = F.broadcast(rows.filter(sampled(F.col("label_id"), most / max(1, n))))
    return docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("label_id")).select("toxic", F.coalesce("text", F.lit("")).alias("text"))


def learn_lexicon(some: DataFrame, least: int = 4, precision: float = 0.8, chance: float = 0.5) -> dict[str, float]:
    """Words and stems (4 to 8 letters, marked *) of toxic texts that clean ones lack, with log odds as weights.

    Counted over `some` in Spark, by text; entries that pass reach the driver, at most as many as the sample's toxic
    texts have words and stems. Of those many, an entry counts only if its likelihood ratio is one that less than about one in all of them would
    have by chance (`chance` of them, to be exact). Where a stem covers another entry, the one with the higher odds
    stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = set(TOKEN.findall(text.as_py().lower()))
                keys = list({w for w in words if len(w) >= 3} | {w[:n] + "*" for w in words for n in range(4, 9) if len(w) >= n})
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(keys), pa.int32()), pa.array(keys, pa.string())], names=["toxic", "entry"])

    n = {r["toxic"]: r["n"] for r in some.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return {}
    counts = some.mapInArrow(run, "toxic int, entry string").groupBy("entry").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    counts, path = written(counts.filter(F.col("a") + F.col("b") >= least), "entries")
    tried = max(1, counts.count())
    # log likelihood of the entry's own share of toxic texts against the share of all
    seen, overall = F.col("a") + F.col("b"), n[1] / (n[1] + n[0])
    own = F.when(F.col("a") > 0, F.col("a") * F.ln(F.col("a") / seen / overall)).otherwise(0) + F.when(F.col("b") > 0, F.col("b") * F.ln(F.col("b") / seen / (1 - overall))).otherwise(0)
    surely = own >= math.log(tried / chance)
    share = (F.col("a") / n[1]) / (F.col("a") / n[1] + F.col("b") / n[0])
    odds = F.ln((F.col("a") + 0.5) / (n[1] + 1)) - F.ln((F.col("b") + 0.5) / (n[0] + 1))
    rows = counts.filter((F.col("a") >= least) & (F.col("a") >= precision * (F.col("a") + F.col("b"))) & (share >= precision) & surely).withColumn("odds", odds).orderBy(F.desc("odds"), "entry").collect()
    remove(some.sparkSession, path)
    out, stems, begun = {}, set(), set()
    for r in rows:
        body = r["entry"].rstrip("*")
        begins, stem = {body[:k] for k in range(4, min(8, len(body)) + 1)}, body != r["entry"]
        if not begins & stems and not (stem and body in begun):
            out[r["entry"]] = float(r["odds"])
            begun |= begins
            stems |= {body} if stem else set()
    return out


def learn_score(some: DataFrame, lexicon: dict[str, float]) -> list[float]:
    """Logistic regression of `toxic` on FEATURES, by Newton steps with a small ridge; an intercept comes first."""
    rows = np.array(_features(some, lexicon, "toxic", "int").toPandas(), dtype=float).reshape(-1, FEATURES + 1)
    rows = rows[np.lexsort(rows.T)]  # sums agree at every run
    if not len(rows):
        return [-10.0] + [0.0] * FEATURES
    x, y, b = np.c_[np.ones(len(rows)), rows[:, 1:]], rows[:, 0], np.zeros(FEATURES + 1)
    ridge = np.diag([1e-6] + [0.5] * FEATURES)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ b)
        b += step
        if abs(step).max() < 1e-8:
            break
    return [float(v) for v in b]


def _features(docs: DataFrame, lexicon: dict[str, float], key: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            rows = [scorer.features(x.as_py() or "") for x in batch.column(1)]
            columns = list(zip(*rows)) if rows else [()] * FEATURES
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in columns)], names=[key, *(f"f{i}" for i in range(FEATURES))])

    return docs.select(F.col(key).cast(kind), "text").mapInArrow(run, f"{key} {kind}, " + ", ".join(f"f{i} double" for i in range(FEATURES)))


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> tuple[dict[str, float], list[float]]:
    """Lexicon and score learned from at most about `most` labelled rows outside the held-out fold, chosen by a hash.

    Rows with a null id or label teach nothing; null texts count as empty; repeated rows count as often as they are
    there. From empty tables, or labels of one kind, nothing is learned and no text is predicted to be toxic."""
    some = _some(docs, labels, most)
    lexicon = learn_lexicon(some)
    return lexicon, learn_score(some, lexicon)


def score(docs: DataFrame, model: tuple[dict[str, float], list[float]]) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.

    Null and empty texts match nothing and get the score of that; equal rows get equal scores; a null id is not held
    out; an empty table gives no rows; other columns are ignored."""
    lexicon, b = model
    z = F.lit(b[0])
    for i, w in enumerate(b[1:]):
        z = z + F.col(f"f{i}") * w
    out = _features(docs, lexicon, "doc_id", dict(docs.dtypes)["doc_id"]).withColumn("score", 1 / (1 + F.exp(-z)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: tuple[dict[str, float], list[float]], threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below the threshold.

    Rows are judged by text alone, so repeated rows and null ids fare alike; null and empty texts match nothing and
    stay; an empty table stays empty."""
    lexicon, b = model
    bar = math.log(threshold / (1 - threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            z = [b[0] + sum(w * f for w, f in zip(b[1:], scorer.features(x.as_py() or ""))) for x in texts]
            yield batch.filter(pa.array([v < bar for v in z], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
