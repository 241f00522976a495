"""Licence scans: Dice coefficient over word bigrams between normalised text and licence templates."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.license_templates import TEMPLATES

WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
SCHEMA = "license string, dice double, first_word int, n_words int"


def normalised(text: str | None) -> list[str]:
    """Case-folded words; numbers keep inner points, all other punctuation goes."""
    return WORD.findall((text or "").casefold())


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        self.sets, self.owners = {}, {}
        for name, text in templates.items():
            words = normalised(text)
            self.sets[name] = frozenset(zip(words, words[1:]))
            for b in self.sets[name]:
                self.owners.setdefault(b, []).append(name)
        # 2 min / (min + max) >= t bounds the larger set by (2 - t) / t times the smaller
        ratio = (2 - threshold) / threshold
        self.bounds = {k: (math.ceil(len(v) / ratio - 1e-9), math.floor(len(v) * ratio + 1e-9)) for k, v in self.sets.items()}

    def scan_all(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(name, dice, first word, words) of windows taken one by one: each time the best that is left of each template
        and overlaps none taken, and of these the one with the highest coefficient, then the longer."""
        words = normalised(text)
        hits: dict[str, list[int]] = {}
        for i, b in enumerate(zip(words, words[1:])):
            for name in self.owners.get(b, ()):
                hits.setdefault(name, []).append(i)
        left = {}
        for name, at in hits.items():
            low, high = self.bounds[name]
            if 2 * len(at) >= self.threshold * (len(self.sets[name]) + low) - 1e-9:
                # the best last, to be popped
                left[name] = sorted(self._windows(words, self.sets[name], at, low, high), reverse=True)
        starts, taken = [], []
        while True:
            best = None
            for name, windows in left.items():
                while windows:
                    dice, start, end = windows[-1]
                    k = bisect_right(starts, end + 1)  # only the last that starts within it can overlap
                    if not k or starts[k - 1] + taken[k - 1][3] <= start:
                        key = dice, start - end, start, name
                        best = key if best is None else min(best, key)
                        break
                    windows.pop()
            if best is None:
                return taken
            dice, n, start, name = best
            k = bisect_right(starts, start)
            starts.insert(k, start)
            taken.insert(k, (name, -dice, start, 2 - n))

    def _windows(self, words: list[str], template: frozenset, at: list[int], low: int, high: int) -> Iterator[tuple]:
        """(-dice, first bigram, last bigram) of all windows at the threshold that start and end with a bigram of the
        template; of those with one start and as many of its bigrams the shortest, as no other is ever taken.

        Starts go from right to left, and what lies after a start is kept as the first place of each bigram, in order:
        a step moves one bigram to the front, and no window looks at more than `high` + 1 of them."""
        first: OrderedDict[tuple[str, str], int] = OrderedDict()
        done = at[-1] + 1
        for start in reversed(at):
            for i in range(done - 1, start - 1, -1):
                b = words[i], words[i + 1]
                first[b] = i
                first.move_to_end(b, last=False)
            done, both = start, 0
            for size, (b, end) in enumerate(islice(first.items(), high), 1):
                if b in template:
                    both += 1
                    if size >= low and (dice := 2 * both / (len(template) + size)) >= self.threshold - 1e-12:
                        yield -dice, start, end


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """doc_id, license, dice, first_word and n_words for each licence found in a whole text.

    Compared are windows of consecutive words that start and end with a bigram of the template and whose number of
    distinct bigrams the size bounds allow. Of all windows of all templates at the threshold, those are taken one by one
    that overlap none taken before: for each template the best (ties to the earlier, then the shorter), of different
    templates the one with the highest coefficient (then the longer). So each occurrence apart gives a row. Templates are a fixed list and go to every task. Null and empty
    texts and empty tables give no rows; repeated rows and null or equal ids are scanned apart; other columns are
    ignored. Templates under two words match nothing."""
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in batches:
            rows = [(i, *x) for i, text in enumerate(batch.column(1)) for x in scanner.scan_all(text.as_py())]
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], kinds))], names=["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))])

    return docs.select(F.col("doc_id"), "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {SCHEMA}")
