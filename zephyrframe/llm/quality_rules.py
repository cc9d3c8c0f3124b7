"""Quality rules as a ledger of failure bits and measurements.

Every rule is evaluated once: a document's measurements are taken in one pass
over its whole text and each rule adds one bit to `failure_bits`. The ledger is
stored by the version of its rules and read back. Policies are versioned rows of
masks over those bits; applying one, comparing versions and ablating single rules
are bitwise work on the stored ledger alone, without the texts.

Defined results: a null or empty text has no words, fails `few_words` and no
ratio rule. Repeated rows give repeated results, an empty table an empty ledger.
Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyrframe.llm.common import scratch_path, unused

WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps"]
#: Rules by bit: name and the condition on the measurements (a column by name) that makes a document fail.
RULES: list[tuple[str, Callable[[Callable[[str], Column]], Column]]] = [
    ("few_words", lambda m: m("n_words") < 20),
    ("repeated_passages", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
    ("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    ("duplicate_lines", lambda m: 100 * m("n_dup_lines") > 50 * m("n_lines")),
    ("word_length", lambda m: (m("word_chars") > 20 * m("n_words")) | (m("word_chars") < 2 * m("n_words"))),
    ("capitals", lambda m: 2 * m("n_caps") > m("n_words")),
]
#: Version of the rules above, by which ledgers are stored; any change of a rule takes the next one.
RULES_VERSION = 1
BASE = ("few_words", "repeated_passages")
#: Policies by name and version: the rules that reject.
POLICIES = [
    ("base", 1, BASE),
    ("production", 1, (*BASE, "symbols", "duplicate_lines")),
    ("production", 2, tuple(name for name, _ in RULES)),
]


def bit(rule: str) -> int:
    """The bit of a rule."""
    return 1 << [name for name, _ in RULES].index(rule)


def mask(policy: str, version: int | None = None) -> int:
    """The bits that a policy rejects by; without a version its latest."""
    found = [(v, rules) for name, v, rules in POLICIES if name == policy and version in (None, v)]
    if not found:
        raise KeyError(f"no policy {policy} of version {version}")
    return sum(map(bit, max(found)[1]))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice in the text, the first included.

    Windows are named exactly by doubling: numbers of single words, then of
    pairs of numbers, until a number stands for a whole window.
    """
    n = len(words)
    if n < window + 1:
        return 0
    numbers: dict[bytes, int] = {}
    names = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    size = 1
    while size < window:
        step = min(size, window - size)
        names = np.unique(names[:-step] * (n + 1) + names[step:], return_inverse=True)[1]
        size += step
        if len(names) == int(names.max()) + 1:
            return 0  # already all different
    again = np.bincount(names)[names] > 1
    delta = np.zeros(n + 1, np.int64)
    starts = np.nonzero(again)[0]
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + window, -1)
    return int((np.cumsum(delta) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The measurements of a text, in the order of MEASURES."""
    raw = text.encode()
    words = raw.split()
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), sum(map(bytes.isupper, words))


def failure_bits(measured: Callable[[str], Column]) -> Column:
    """One bit for each rule that the measurements fail."""
    return sum((F.when(rule(measured), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, rule) in enumerate(RULES)), F.lit(0)).cast("long")


def with_measures(docs: DataFrame, text_col: str = "text", name: str = "measures") -> DataFrame:
    """The rows of `docs` with a struct of MEASURES under an unused name, taken in one pass where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(v.as_py() or "") for v in batch.column(text_col)]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(columns, MEASURES)], [*batch.schema.names, name])

    kind = "struct<" + ", ".join(f"{m}: bigint" for m in MEASURES) + ">"
    schema = docs.sparkSession.createDataFrame([], docs.schema).withColumn(name, F.lit(None).cast(kind)).schema
    return docs.mapInArrow(run, schema)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measurements and failure_bits; one row for each row, no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    book = with_measures(rows).select(F.col("id").alias(id_col), "measures.*")
    return book.withColumn("failure_bits", failure_bits(F.col))


def store_ledger(book: DataFrame, path: str) -> None:
    """Write a ledger below `path` under the version of its rules; that version's earlier ledger is replaced."""
    book.write.mode("overwrite").parquet(f"{path}/rules_version={RULES_VERSION}")


def read_ledger(spark: SparkSession, path: str, rules_version: int = RULES_VERSION) -> DataFrame:
    """The stored ledger of a version of the rules."""
    return spark.read.parquet(f"{path}/rules_version={rules_version}")


def stored_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """The ledger of `docs`, written below `path` (or the shared folder) and read back, so that no policy reads a text again."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "ledger")
    store_ledger(ledger(docs, id_col, text_col), path)
    return read_ledger(spark, path)


def policy_table(spark: SparkSession) -> DataFrame:
    """The versioned policies: policy, version, mask."""
    return spark.createDataFrame([(name, version, mask(name, version)) for name, version, _ in POLICIES], "policy string, version int, mask long")


def apply_policy(book: DataFrame, policy: str = "production", version: int | None = None) -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    base, bits = mask("base"), mask(policy, version)
    return book.withColumn("base_failed", F.col("failure_bits").bitwiseAND(F.lit(base)) != 0).withColumn("kept", F.col("failure_bits").bitwiseAND(F.lit(base | bits)) == 0)


def ablations(book: DataFrame, policy: str = "production", version: int | None = None) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that it alone rejects.

    One aggregation over the ledger: all rules are counted from the same bits.
    """
    bits = mask(policy, version)
    failed = F.col("failure_bits").bitwiseAND(F.lit(bits))
    mine = [(name, 1 << k) for k, (name, _) in enumerate(RULES) if bits >> k & 1]
    counts = book.agg(*[F.count_if(failed.bitwiseAND(F.lit(b)) != 0).alias(f"failed_{n}") for n, b in mine], *[F.count_if(failed == b).alias(f"alone_{n}") for n, b in mine])
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"failed_{n}").alias("failed"), F.col(f"alone_{n}").alias("rejected_alone")) for n, _ in mine])
    return counts.select(F.inline(rows))


def keep_passing(docs: DataFrame, text_col: str = "text", policy: str = "production", version: int | None = None) -> DataFrame:
    """The rows of `docs` that pass a policy, all columns kept; the bits are the ledger's, judged where rows are read."""
    bits = mask("base") | mask(policy, version)
    (name,) = unused(docs, "__measures")
    failed = failure_bits(lambda m: F.col(f"`{name}`.{m}"))
    return with_measures(docs, text_col, name).filter(failed.bitwiseAND(F.lit(bits)) == 0).drop(name)
