"""Quality rules as a short-circuit cascade.

Each rule looks at a few features of one text and may reject it. Rules share lazily computed
features, so a rule that is reached late often costs nothing because the text is already rejected.
A bounded sample of rows tells, for each rule, what it costs and how much it rejects; the cascade
runs in descending order of rejections per second. A text is kept if no rule rejects it, so the
order changes the cost and never the verdict.

Defined cases: a null or empty text has no words and is rejected as too short; very long
texts are judged whole, a slice of their own; ties in the order of rules change no verdict;
rows are judged one by one, so repeated rows and repeated or null ids give one result each; extra columns are ignored.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.llm.common import WORD, columns_of, map_texts

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


class Features:
    """Features of one text, each computed when a rule first asks for it."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[str]:
        return WORD.findall(self.text)

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def _lines(self) -> tuple[int, int]:
        lines = [x for x in self.text.split("\n") if WORD.search(x)]
        return len(lines), len(lines) - len(set(lines))

    @property
    def n_lines(self) -> int:
        return self._lines[0]

    @property
    def n_dup_lines(self) -> int:
        return self._lines[1]

    @cached_property
    def n_repeat_words(self) -> int:
        """Words covered by three-word windows that occur twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        found = Counter(windows)
        if len(found) == len(windows):
            return 0
        covered = end = 0
        for i, x in enumerate(windows):
            if found[x] > 1:
                covered += i + 3 - max(end, i)
                end = i + 3
        return covered

    @cached_property
    def _case(self) -> tuple[int, int]:
        b = np.frombuffer(self.text.encode("utf-8", "replace"), np.uint8)
        n = np.bincount(b, minlength=256)
        return int(n[65:91].sum()), int(n[97:123].sum())

    @property
    def n_upper(self) -> int:
        return self._case[0]

    @property
    def n_lower(self) -> int:
        return self._case[1]


Rule = Callable[[Features], bool]

#: The two rules of the base, which reject whatever the rest says.
BASE: dict[str, Rule] = {
    "few_words": lambda d: d.n_words < 50,
    "repeated_words": lambda d: 100 * d.n_repeat_words > 50 * d.n_words,
}

#: All rules; each is true for a text to be rejected.
RULES: dict[str, Rule] = BASE | {
    "symbols": lambda d: 100 * d.n_symbols > 30 * d.n_words,
    "repeated_lines": lambda d: 100 * d.n_dup_lines > 50 * d.n_lines,
    "shouting": lambda d: d.n_upper > d.n_lower,
    "word_length": lambda d: not 2 * d.n_words <= d.word_chars <= 15 * d.n_words,
}

#: Rows of the sample from which the order of the rules is taken.
SAMPLE_ROWS = 512


def rule_order(df: DataFrame, text_col: str = "text", rules: dict[str, Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules by rejections per second on a sample, the best first.

    The sample is the first rows of a few partitions, ``sample_rows`` in all at most. Executors measure
    them and return three numbers a rule; ``take`` runs only as many partitions as it needs, and
    nothing is shuffled. Without rows, or on a tie, the rules keep their given order."""
    names, partitions = list(rules), 8

    def measure(batches):
        seconds, rejected, left = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0), sample_rows // partitions
        for batch in batches:
            for text in batch.column(0).slice(0, left).to_pylist():
                for name in names:
                    d = Features(text or "")  # afresh, so that a rule pays for its own features
                    start = time.perf_counter()
                    rejected[name] += rules[name](d)
                    seconds[name] += time.perf_counter() - start
                left -= 1
            if not left:
                break
        yield pa.RecordBatch.from_pydict({"rule": names, "s": [seconds[n] for n in names], "n": [rejected[n] for n in names]})

    seconds, rejected = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0)
    for row in df.select(F.col(text_col).alias("t")).mapInArrow(measure, "rule string, s double, n long").take(partitions * len(names)):
        seconds[row["rule"]] += row["s"]
        rejected[row["rule"]] += row["n"]
    return sorted(names, key=lambda n: -rejected[n] / max(seconds[n], 1e-9))


def first_rejection(d: Features, rules: dict[str, Rule], order: list[str]) -> str | None:
    return next((name for name in order if rules[name](d)), None)


def apply_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, Rule] = RULES, order: list[str] | None = None) -> DataFrame:
    """One row per input row: ``id``, the base features, ``base_failed`` and ``kept``."""
    order = order or rule_order(df, text_col, rules)

    def work(ids, texts):
        docs = [Features(t) for t in texts]
        kept = [first_rejection(d, rules, order) is None for d in docs]
        out = {c: [getattr(d, c) for d in docs] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        return {"id": ids} | out | {"base_failed": [any(r(d) for r in BASE.values()) for d in docs], "kept": kept}

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return map_texts(columns_of(df, id_col, text_col), lambda: work, schema)


def keep_good(df: DataFrame, text_col: str = "text", rules: dict[str, Rule] = RULES) -> DataFrame:
    """The rows of ``df`` that no rule rejects, with all their columns. Only the verdict is
    computed, so most rejected texts never pay for the dear features. No shuffle, no join."""
    order = rule_order(df, text_col, rules)
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            keep = [first_rejection(Features(t or ""), rules, order) is None for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)
