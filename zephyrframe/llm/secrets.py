"""Secret scans: fixed patterns, and character Markov models compared by likelihood ratio.

The patterns (assignments, access keys, long hexadecimal strings) give the base
spans. Other candidates are runs of at least 12 token characters with a letter
that aren't plain words: they hold a digit, a mark other than the hyphen, or a
capital after a small letter. A first-order Markov model of random strings and one
of ordinary identifiers give each a log-likelihood ratio, and those above a
threshold become spans of kind `markov` where no base span overlaps them.

The models count character pairs of labelled samples. Random: what the patterns
find in the corpus, and strings drawn from hashes. Ordinary: the corpus' words in
usual spelling outside the patterns' matches, and identifiers joined from them;
tokens of mixed characters have no label, as unknown secrets may be among them. The samples
come from the `documents` documents of lowest hash of their id, a bounded sample;
scanning covers all documents. Four fifths of the tokens train; of the others the
ordinary ones set the threshold at a stated false-positive rate, never below 0.

All of it is built from DataFrame functions; documents are not shuffled, only
hashes of their ids. The models are one array of alphabet-squared numbers.

Defined results: a null or empty text has no spans. Without ordinary tokens to
learn from (an empty corpus) there are no `markov` spans. Repeated rows give
repeated results, an empty table an empty result. Only the id and text columns are
read. Whole texts are scanned; positions and overlaps of many matches in one long
text are found in blocks, so the work stays near linear.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyrframe.llm.common import materialize

#: The base patterns, and how long a match must be to count.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32
KINDS = ("assign", "access", "hex", "markov")
#: Characters of candidates, in the order of the models' rows.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CLASS = "[A-Za-z0-9+/_=-]"
CANDIDATE = rf"(?<!{_CLASS})(?={_CLASS}{{12}})(?={_CLASS}*[A-Za-z])(?={_CLASS}*[0-9+/_=]|[A-Z-]*+[a-z]{_CLASS}*[A-Z]){_CLASS}+"


@dataclass(frozen=True)
class RandomModel:
    """For each pair of alphabet characters the log-ratio of following, random over ordinary, and the sum above which a token counts."""

    ratios: list[float]
    threshold: float


def drawn_samples(spark: SparkSession, rows: int) -> DataFrame:
    """token, random: strings drawn from hashes, hexadecimal and base64 ones."""
    ids = spark.range(rows)
    dense = F.base64(F.unhex(F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)))
    hexed = F.sha2(F.concat(F.lit("digits"), F.col("id").cast("string")), 256)
    random = F.when(F.col("id") % 4 == 0, F.substring(hexed, 1, 40)).otherwise(F.substring(dense, 1, 40))
    return ids.select(random.alias("token"), F.lit(True).alias("random"))


def corpus_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = 2000, drawn: int = 4000) -> DataFrame:
    """token, random: distinct labelled tokens of the `documents` documents of lowest hash of their id, and drawn ones."""
    order = F.xxhash64(F.lit("sample"), F.col(id_col))
    last = docs.select(order.alias("order")).distinct().orderBy("order").limit(documents).agg(F.max("order")).first()[0]
    some = materialize(docs.filter(order <= (last or 0)).filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")))
    every = lambda pattern, group=0: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    values = F.concat(F.filter(every(ASSIGN, 2), lambda v: (F.length(v) >= ASSIGN_LENGTH) & v.rlike("[0-9]")), F.filter(every(ACCESS), lambda v: F.length(v) >= ACCESS_LENGTH), every(rf"[0-9a-f]{{{HEX_LENGTH},}}"))
    random = some.select(F.explode(values).alias("token"), F.lit(True).alias("random"))
    rest = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), rf"{ACCESS}|[0-9a-f]{{{HEX_LENGTH},}}", " ")
    plain = some.select(F.explode(F.regexp_extract_all(rest, F.lit(_CLASS + "{4,}"), F.lit(0))).alias("token")).filter("token rlike '^([A-Z]?[a-z]+|[A-Z]+)$'").distinct()
    words = materialize(plain.select(F.lower("token").alias("word")).filter("word rlike '^[a-z]{3,12}$'").distinct())
    # Words of one hash class make an identifier, about three; each word takes part in twelve. Every second has a number.
    classes = max(1, words.count() // 3)
    turns = words.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(12))))
    listed = turns.groupBy("turn", F.pmod(F.xxhash64("turn", "word"), F.lit(classes)).alias("g")).agg(F.slice(F.sort_array(F.collect_list("word")), 1, 4).alias("w"))
    number = F.when(F.col("g") % 2 == 0, F.pmod(F.xxhash64(F.lit("number"), "g"), F.lit(2100)).cast("string"))
    joint = lambda mark, w=F.col("w"): F.concat_ws(mark, w, number)
    kind = F.col("g") % 5
    capital = F.transform("w", lambda x: F.initcap(x))
    spelt = F.when(kind == 0, joint("_")).when(kind == 1, joint("-")).when(kind == 2, joint("/")).when(kind == 3, F.upper(joint("_"))).otherwise(joint("", capital))
    ordinary = plain.unionByName(listed.select(spelt.alias("token"))).select("token", F.lit(False).alias("random"))
    return random.unionByName(ordinary).unionByName(drawn_samples(docs.sparkSession, drawn)).distinct()


def held_out() -> Column:
    """Whether a token is kept from training, a fifth by hash."""
    return F.pmod(F.xxhash64("token"), F.lit(5)) == 0


def train_models(samples: DataFrame) -> list[float]:
    """For each pair of alphabet characters the log-ratio of following: random over ordinary.

    Counts of pairs are aggregated first; the driver gets alphabet-squared numbers at most.
    """
    size = len(ALPHABET)
    at = F.expr(f"transform(sequence(1, length(token) - 1), i -> struct(instr('{ALPHABET}', substring(token, i, 1)) as a, instr('{ALPHABET}', substring(token, i + 1, 1)) as b))")
    pairs = samples.filter("length(token) > 1").select("random", F.inline(at)).filter("a > 0 and b > 0")
    counts = {(r["random"], r["a"], r["b"]): r["count"] for r in pairs.groupBy("random", "a", "b").count().collect()}

    def logs(random: bool) -> list[float]:
        out = []
        for a in range(1, size + 1):
            row = [counts.get((random, a, b), 0) + 0.5 for b in range(1, size + 1)]
            out += [math.log(x / sum(row)) for x in row]
        return out

    return [r - o for r, o in zip(logs(True), logs(False))]


def log_ratio(token: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a token, summed over its character pairs."""
    values = F.expr("cast(split('" + ",".join(f"{x:.6f}" for x in model) + "', ',') as array<double>)")
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))
    place = lambda i: ((at(i) - 1) * len(ALPHABET) + at(i + 1) - 1).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda total, i: total + F.get(values, place(i)))


def fit(samples: DataFrame, false_rate: float = 0.001) -> RandomModel:
    """Models of the training tokens, and the threshold that `false_rate` of the held-out ordinary candidates exceed."""
    samples = materialize(samples)
    ratios = train_models(samples.filter(~held_out()))
    rest = samples.filter(held_out() & ~F.col("random") & (F.length("token") > 1)).select(log_ratio(F.col("token"), ratios).alias("ratio"))
    limit = rest.agg(F.percentile("ratio", F.lit(1 - false_rate))).first()[0]
    return RandomModel(ratios, math.inf if limit is None else max(limit, 0.0))


def judged(samples: DataFrame, model: RandomModel) -> DataFrame:
    """One row on the held-out candidates among samples: n_random, n_ordinary, recall, false_rate, precision."""
    rest = samples.filter(held_out()).filter(F.col("token").rlike(f"^{CANDIDATE}$")).select("random", (log_ratio(F.col("token"), model.ratios) > model.threshold).alias("caught"))
    count = lambda c: F.count_if(c)
    random, caught = F.col("random"), F.col("caught")
    sums = rest.agg(count(random).alias("n_random"), count(~random).alias("n_ordinary"), count(random & caught).alias("right"), count(~random & caught).alias("wrong"))
    share = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return sums.select("n_random", "n_ordinary", share("right", "n_random").alias("recall"), share("wrong", "n_ordinary").alias("false_rate"), F.try_divide(F.col("right"), F.col("right") + F.col("wrong")).alias("precision"))


def _running(values: Column, start: Column, add: Callable[[Column, Column], Column]) -> Column:
    """The folds before each value, beginning with start."""
    zero = F.struct(start.cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(values, zero, lambda s, v: F.struct(add(s["sum"], v).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out")), lambda s: s["out"])


def folds_before(values: Column, zero: int, add: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """For each value of an array the fold (sum, greatest, ...) of those before it, by blocks of values."""
    first = F.lit(zero).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda b: F.slice(values, b * block + 1, F.lit(block)))
    heads = _running(F.transform(blocks, lambda x: F.aggregate(x, first, add)), first, add)
    return F.flatten(F.zip_with(blocks, heads, lambda x, h: _running(x, h, add)))


def sums_before(values: Column) -> Column:
    """For each value of an array the sum of those before it."""
    return folds_before(values, 0, lambda s, v: s + v)


def apart_from(spans: Column, base: Column) -> Column:
    """The spans that overlap none of `base` (both arrays of start, kind, end, token), by one merge of both in order."""
    far = 1 << 40
    most = lambda s, v: F.greatest(s, v)
    event = lambda own: lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s["kind"].alias("kind"), s["token"].alias("token"))
    events = F.array_sort(F.concat(F.transform(base, event(0)), F.transform(spans, event(1))))
    is_base = lambda e: e["own"] == 0
    reached = folds_before(F.transform(events, lambda e: F.when(is_base(e), e["end"]).otherwise(F.lit(-far)).cast("long")), -far, most)
    # The next base span from the right: the greatest of negated starts.
    ahead = F.reverse(folds_before(F.transform(F.reverse(events), lambda e: F.when(is_base(e), -e["start"]).otherwise(F.lit(-far)).cast("long")), -far, most))
    rows = F.arrays_zip(events.alias("e"), reached.alias("r"), ahead.alias("a"))
    free = F.filter(rows, lambda x: (x["e"]["own"] == 1) & (x["r"] <= x["e"]["start"]) & (-x["a"] >= x["e"]["end"]))
    return F.transform(free, lambda x: F.struct(x["e"]["start"].alias("start"), x["e"]["kind"].alias("kind"), x["e"]["end"].alias("end"), x["e"]["token"].alias("token")))


def match_spans(text: Column, pattern: str, kind: int, keep: Callable[[Column, Column], Column], group: int = 0) -> Column:
    """Leftmost non-overlapping matches as array of (start, kind, end, token) in code points; `keep` gets match and group."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("long"))
    lengths = F.transform(matches, lambda m: F.length(m).cast("long"))
    before = sums_before(F.zip_with(F.slice(between, F.lit(1), F.size(matches)), lengths, lambda a, b: a + b))
    rows = F.arrays_zip(matches.alias("m"), groups.alias("g"), between.alias("p"), before.alias("b"))
    rows = F.filter(rows, lambda r: r["m"].isNotNull() & keep(r["m"], r["g"]))
    start = lambda r: r["b"] + r["p"]
    return F.transform(rows, lambda r: F.struct(start(r).alias("start"), F.lit(kind).alias("kind"), (start(r) + F.length(r["m"])).alias("end"), r["m"].alias("token")))


_SPANS = "array<struct<start:bigint,kind:int,end:bigint,token:string>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: RandomModel | None = None, documents: int = 2000, false_rate: float = 0.001) -> DataFrame:
    """id, base and found: arrays of (start, kind, end, token), one row for each row of `docs`. Without a model one is fitted on the corpus."""
    if model is None:
        model = fit(corpus_samples(docs, id_col, text_col, documents), false_rate)
    text = F.col("text")
    none = F.array().cast(_SPANS)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lowered = F.lower("text")
    # Cheap tests first: most texts have nothing to lay out.
    hints = rows.withColumn("has_word", lowered.contains("passw") | lowered.contains("secret") | lowered.contains("token") | lowered.contains("apikey") | lowered.contains("api_key"))
    assign = match_spans(text, ASSIGN, 0, lambda m, g: F.length(g) >= ASSIGN_LENGTH, 2)
    access = match_spans(text, ACCESS, 1, lambda m, g: F.length(m) >= ACCESS_LENGTH)
    # Only runs of hexadecimal digits that are long enough count, so shorter ones need not be laid out.
    hexes = match_spans(text, rf"[0-9a-f]{{{HEX_LENGTH},}}", 2, lambda m, g: F.lit(True))
    random = match_spans(text, CANDIDATE, 3, lambda m, g: log_ratio(m, model.ratios) > model.threshold)
    spans = hints.select(
        "id",
        F.array_sort(F.concat(F.when(F.col("has_word"), assign).otherwise(none), F.when(text.contains("AKIA"), access).otherwise(none), F.when(text.rlike(rf"[0-9a-f]{{{HEX_LENGTH}}}"), hexes).otherwise(none)).cast(_SPANS)).alias("base"),
        F.when(text.rlike(CANDIDATE), random).otherwise(none).cast(_SPANS).alias("more"),
    )
    free = apart_from(F.col("more"), F.col("base"))
    return spans.select(F.col("id").alias(id_col), "base", F.when((F.size("more") > 0) & (F.size("base") > 0), free).otherwise(F.col("more")).alias("found"))


def described(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    named = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(named, ",")


def secret_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(described(F.col("base")), 256).alias("base_sha256"), described(F.concat("base", "found")).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """A text with its spans (array of start, kind, end, token) replaced from the last to the first."""
    ordered = F.reverse(F.array_sort(spans))
    cut = lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"].cast("int")), F.lit(mark), F.substring(t, (s["end"] + 1).cast("int"), F.length(t)))
    return F.aggregate(ordered, text, cut)
