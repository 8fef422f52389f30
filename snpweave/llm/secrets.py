"""Secret scans: key patterns, and a randomness test battery for strings that no pattern names.

DataFrame functions only. Patterns give spans of kind assign, access and hex. The battery looks at what they leave: every
maximal run of at least LEAST key-like characters; an inner "=" ends a run, up to two at the end are padding.

- encoding: the smallest alphabet that holds it (digits, hex and UUIDs, letters of one case, base32, lower or upper case with
  digits, base64);
- uniformity: chi-squared of its symbol counts against equal shares;
- runs: the number of changes between lower case, upper case and digits (one less than that of runs);
- serial correlation: the number of changes between vowels and consonants among neighbouring letters, and the correlation
  of neighbouring symbol numbers.

Each test has two sides. Random strings of the encoding: a string stays in question while no test rejects that (each at
REJECT). Ordinary text: the same statistics are far from those of random strings (symbols as uneven as letters of Latin
scripts, few changes of class, vowels and consonants taking turns), the farther the longer the string. A test's z-value
against text is weighted by the distance between the two in standard deviations, which follows from encoding and length, so
a test counts as much as it can tell; the weighted sum gives one p-value a string. Strings that the first side rejects have
p = 1. Benjamini-Hochberg over all distinct strings of one encoding and length class (half octaves), counted by tenths of log10
p, controls the share of false ones, at the rate times the share of classes in which anything passes: the many short words of a
corpus don't count against long strings. What passes are spans of kind random. Nothing but the p-values decides: short strings of small
alphabets cannot reach those that their full classes ask for, and digits alone have no ordinary text to differ from (p = 0.5).

Texts are read twice: first for the distinct strings, whose tests give the cuts; then for the places of strings, only in
lengths and shapes of which some string passed.

Null or empty text: no spans. Null ids and repeated rows: a row each. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snpweave.llm.common import materialize, small_or_shuffled, with_text

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
LEAST = 8  # what is shorter than any accepted password is no key
KEY = "[A-Za-z0-9+/_-]"
UUID = "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
KINDS = ("assign", "access", "hex", "random")
B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
# ordinary text: chance that two of its letters are equal, share of neighbours of different class, and of letters that are
# neighbours of which one is a vowel
TEXT_EQUAL, TEXT_CHANGES, TEXT_TURNS = 0.065, 0.15, 0.6
REJECT = 0.001
BLOCK = 256

# encodings: alphabet, letters and digits in each of its classes, vowels and consonants among its letters
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    (DIGITS + LOWER[:6], (10, 6), (2, 4)),  # hex
    (UPPER + "234567", (26, 6), (5, 21)),  # base32
    (DIGITS + LOWER, (26, 10), (5, 21)),
    (DIGITS + UPPER, (26, 10), (5, 21)),
    (B64, (26, 26, 10), (5, 21)),
    (LOWER, (26,), (5, 21)),
    (UPPER, (26,), (5, 21)),
    (DIGITS, (10,), (5, 21)),
)
ONE_CASE = (5, 6, 7)

_SPAN = "struct<at:int, kind:int, stop:int>"


def run_pattern(any_shape: int, mixed: int) -> str:
    """Maximal runs of key-like characters with their padding: of any shape from one length on, and such as hold two of lower
    case, upper case, digits and signs from another."""
    run = lambda n: rf"{KEY}{{{n},}}+"
    two = rf"(?!(?:[a-z]+|[A-Z]+|[0-9]+)(?!{KEY}))"
    return rf"(?<!{KEY})(?:{run(any_shape)}|{two}{run(mixed)})(?:={{1,2}}(?![A-Za-z0-9+/_=-]))?"


def _spans(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """Spans of all matches of the pattern, from the lengths of the matches and of the pieces between them, added up by
    blocks (one long array would be copied for every match). keep: array of booleans, one a match."""
    rx = F.lit(pattern)
    found = F.regexp_extract_all(text, rx, F.lit(0))
    steps = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(found, F.length).alias("size"), (keep if keep is not None else F.transform(found, lambda _: F.lit(True))).alias("keep"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda k: F.slice(steps, k * BLOCK + 1, BLOCK))
    none = F.array().cast(f"array<{_SPAN}>")
    state = lambda at: F.struct(at.alias("at"), none.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        stop = at + F.coalesce(x["size"], F.lit(0))
        span = F.struct(at.alias("at"), F.lit(kind).alias("kind"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(x["keep"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def join(acc: Column, block: Column) -> Column:
        inner = F.array(F.aggregate(block, state(acc["at"]), add))
        return F.transform(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], x["out"]).alias("out")))[0]

    return F.when(text.rlike(pattern), F.aggregate(blocks, state(F.lit(0)), join, lambda acc: acc["out"])).otherwise(none)


def _masked(text: Column, spans: Column) -> Column:
    """The text with every span turned to blanks."""

    def add(acc: Column, s: Column) -> Column:
        start, stop = F.greatest(acc["at"], s["at"]), F.greatest(acc["at"], s["stop"])
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, start - acc["at"]), F.repeat(F.lit(" "), stop - start))
        return F.struct(stop.alias("at"), out.alias("out"))

    end = F.array(F.struct(F.length(text).alias("at"), F.lit(0).alias("kind"), F.length(text).alias("stop")))
    whole = F.aggregate(F.concat(spans, end), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda acc: acc["out"])
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def _lower_tail(z: Column) -> Column:
    """Standard normal distribution function (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(z < 0, upper).otherwise(1 - upper)


def random_candidates(strings: DataFrame) -> DataFrame:
    """Adds to a column `s`: n (symbols), a (alphabet size), whether the string may be random, and log10 of its p-value
    under ordinary text (0 where it can't be random)."""
    plain, uuid = F.regexp_replace("s", "=+$", ""), F.col("s").rlike(UUID)
    of = lambda p: F.col("s").rlike(p)
    letters = F.when(of("^[a-z]+=*$"), 5).when(of("^[A-Z]+=*$"), 6).when(of("^[0-9]+=*$"), 7)
    hexa = uuid | of("^([0-9a-f]+|[0-9A-F]+)$")
    rest = F.when(hexa, 0).when(of("^[A-Z2-7]+=*$"), 1).when(of("^[a-z0-9]+$"), 2).when(of("^[A-Z0-9]+$"), 3).otherwise(4)
    df = strings.withColumn("kind", F.coalesce(letters, rest))
    body = F.when(uuid, F.lower(F.replace("s", F.lit("-")))).when(F.col("kind") == 0, F.lower(plain)).otherwise(F.translate(plain, "-_", "+/"))
    df = df.withColumn("body", body)
    of_kind = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("kind") + 1)
    df = df.withColumn("alphabet", of_kind([e[0] for e in ENCODINGS]))
    # of random neighbours: share of different class, and of letters of which one is a vowel
    mixed = lambda parts: 1 - sum((p / sum(parts)) ** 2 for p in parts)
    df = df.withColumn("changing", of_kind([mixed(e[1]) for e in ENCODINGS])).withColumn("turning", of_kind([mixed(e[2]) for e in ENCODINGS]))
    df = df.withColumn("n", F.length("body").cast("double")).withColumn("a", F.length("alphabet").cast("double"))
    n = F.col("n")
    # uniformity
    df = df.withColumn("squares", F.expr("aggregate(split(alphabet, ''), 0D, (t, c) -> t + pow(length(body) - length(replace(body, c, '')), 2))"))
    df = df.withColumn("chi2", F.col("a") / n * F.col("squares") - n)
    # runs of one class: neighbours among letters and digits that differ in it
    df = df.withColumn("plain", F.regexp_replace("body", "[+/=]", ""))
    pairs = F.greatest(F.length("plain") - 1, F.lit(1)).cast("double")
    df = df.withColumn("pairs", pairs).withColumn("changes", F.regexp_count("plain", F.lit("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])")).cast("double"))
    # serial correlation
    low = F.lower("plain")
    df = df.withColumn("letters", F.regexp_count(low, F.lit("(?<=[a-z])(?=[a-z])")).cast("double"))
    df = df.withColumn("turns", F.regexp_count(low, F.lit("(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])")).cast("double"))
    df = df.withColumn("x", F.expr("transform(filter(split(body, ''), c -> locate(c, alphabet) > 0), c -> cast(locate(c, alphabet) AS double))"))
    df = df.withColumn("mean", F.expr("aggregate(x, 0D, (t, v) -> t + v) / size(x)"))
    df = df.withColumn("dev", F.expr("transform(x, v -> v - mean)"))
    df = df.withColumn("power", F.expr("aggregate(dev, 0D, (t, v) -> t + v * v)"))
    df = df.withColumn("lagged", F.expr("aggregate(zip_with(slice(dev, 1, greatest(size(dev) - 1, 1)), slice(dev, 2, greatest(size(dev) - 1, 1)), (u, v) -> u * v), 0D, (t, v) -> t + coalesce(v, 0D))"))

    k = F.col("a") - 1
    spread = lambda m, p: F.sqrt(F.greatest(m * p * (1 - p), F.lit(1e-9)))
    # against random strings (chi-squared by Wilson-Hilferty)
    z_chi = (F.pow(F.col("chi2") / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))
    z_runs = F.abs(F.col("changes") - F.col("changing") * F.col("pairs")) / spread(F.col("pairs"), F.col("changing"))
    z_turns = F.when(F.col("letters") > 0, F.abs(F.col("turns") - F.col("turning") * F.col("letters")) / spread(F.col("letters"), F.col("turning"))).otherwise(0.0)
    corr = F.when(F.col("power") > 0, F.col("lagged") / F.col("power")).otherwise(1.0)
    z_serial = F.abs(corr + 1 / n) * F.sqrt(n)
    p = F.least(1 - _lower_tail(z_chi), 2 * (1 - _lower_tail(z_runs)), 2 * (1 - _lower_tail(z_turns)), 2 * (1 - _lower_tail(z_serial)))
    df = df.withColumn("may_be_random", p >= REJECT)

    # against text: z-values, each weighted by how far apart text and random strings are
    excess = F.greatest(n * (F.col("a") * TEXT_EQUAL - 1), F.lit(0.0))  # noncentral chi-squared
    sd_chi = F.sqrt(2 * (k + 2 * excess))
    tests = [((k + excess - F.col("chi2")) / sd_chi, excess / sd_chi)]
    for seen, m, text, rand, up in (("changes", "pairs", TEXT_CHANGES, "changing", 1), ("turns", "letters", TEXT_TURNS, "turning", -1)):
        sd = spread(F.col(m), F.lit(text))
        tests.append((F.when(F.col(m) > 0, up * (F.col(seen) - text * F.col(m)) / sd).otherwise(0.0), F.greatest(up * (F.col(rand) - text) * F.col(m) / sd, F.lit(0.0))))
    z = sum(w * v for v, w in tests) / F.sqrt(F.greatest(sum(w * w for _, w in tests), F.lit(1e-9)))
    df = df.withColumn("z", z)
    tail = F.expr(f"CASE WHEN z > 5 THEN -z * z / 2 - ln(z * {2.5066282746310002}D) ELSE NULL END")
    log_p = F.coalesce(tail, F.log(F.greatest(1 - _lower_tail(F.col("z")), F.lit(1e-300)))) / F.log(F.lit(10.0))
    return df.withColumn("log_p", F.when(F.col("may_be_random"), log_p).otherwise(0.0))


def false_discovery_cuts(tests: DataFrame, rate: float) -> DataFrame:
    """tests(kind, n, log_p) -> kind, octave, top, shortest: the largest tenth of log10 p that Benjamini-Hochberg passes in each
    class of one encoding and half octave of lengths, and the least length of what passes. Classes are selected at the rate
    and then cut at the rate times their share among all classes (Benjamini and Bogomolov). At most a few hundred classes,
    each of at most 3001 tenths."""
    edges = tests.select("kind", _octave(), _edge(), "n").groupBy("kind", "octave", "edge").agg(F.count("*").alias("c"), F.min("n").alias("n"))
    by = Window.partitionBy("kind", "octave")
    share = F.sum("c").over(by.orderBy("edge")) / F.sum("c").over(by)
    edges = materialize(edges.withColumn("share", share), "edges")
    passes = lambda rate: F.col("edge") / 10 <= F.log10(F.col("share") * rate)
    selected = edges.groupBy("kind", "octave").agg(F.max(passes(F.lit(rate)).cast("int")).alias("in")).agg(F.avg("in").alias("part"))  # one row
    top = F.max(F.when(passes(rate * F.col("part")), F.col("edge"))).over(by)
    passed = edges.crossJoin(F.broadcast(selected)).where("part > 0").withColumn("top", top).where("edge <= top")
    return passed.groupBy("kind", "octave").agg(F.max("top").alias("top"), F.min("n").cast("int").alias("shortest"))


def _octave() -> Column:
    return F.floor(F.log2("n") * 2).cast("int").alias("octave")


def _edge() -> Column:
    return F.greatest(F.ceil(F.col("log_p") * 10), F.lit(-3000)).cast("int").alias("edge")


def secret_spans(docs: DataFrame, rate: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_key (xxhash64 of the text), base and added: arrays of (at, kind, stop)."""
    source = with_text(docs, id_col, text_col)
    text = F.col("text")
    long_enough = lambda p, g, n: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(g)), lambda m: F.length(m) >= n)
    base = F.concat(_spans(text, ASSIGN, 0, long_enough(ASSIGN, 2, 6)), _spans(text, ACCESS, 1, long_enough(ACCESS, 0, 20)), _spans(text, HEX, 2))
    found = source.select("doc_id", "text", F.xxhash64("text").alias("text_key"), F.array_sort(base).alias("base"))
    found = found.withColumn("rest", _masked(text, F.col("base")))

    strings = found.select(F.explode(F.array_distinct(F.regexp_extract_all("rest", F.lit(run_pattern(LEAST, LEAST)), F.lit(0)))).alias("s")).distinct()
    tests = materialize(random_candidates(strings).select("s", "kind", F.length("body").alias("n"), "log_p"), "tests")
    cuts = materialize(false_discovery_cuts(tests, rate), "cuts")
    secret = tests.select("s", "kind", _octave(), _edge()).join(F.broadcast(cuts), ["kind", "octave"]).where("edge <= top").select("s")
    secret = small_or_shuffled(materialize(secret, "random"))

    # places: the shortest strings that passed bound the runs worth looking for (padding and hyphens only add to a length)
    one_case = F.col("kind").isin(*ONE_CASE)
    low = cuts.agg(F.min(F.when(one_case, F.col("shortest"))), F.min(F.when(~one_case, F.col("shortest")))).first()
    none = 1 << 30
    pattern = run_pattern(low[0] or none, low[1] or none)
    runs = F.transform(_spans(F.when(F.col("rest").rlike(pattern), F.col("rest")).otherwise(""), pattern, 3), lambda r: F.struct(r["at"].alias("at"), r["stop"].alias("stop"), F.substring("rest", r["at"] + 1, r["stop"] - r["at"]).alias("s")))
    found = materialize(found.select("doc_id", "text_key", "base", runs.alias("runs")), "spans")
    some = found.where(F.size("runs") > 0).select("doc_id", "text_key", F.explode("runs").alias("r")).select("doc_id", "text_key", "r.at", "r.stop", "r.s")
    added = some.join(secret, "s").groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("at", F.lit(3).alias("kind"), "stop"))).alias("added"))
    plain = found.where(F.size("runs") == 0).select("doc_id", "text_key", "base", F.array().cast(f"array<{_SPAN}>").alias("added"))
    f, a = found.where(F.size("runs") > 0).alias("f"), added.alias("a")
    mixed = f.join(a, F.expr("f.doc_id <=> a.doc_id AND f.text_key = a.text_key"), "left")
    return plain.unionAll(mixed.select("f.doc_id", "f.text_key", "f.base", F.coalesce("a.added", F.array().cast(f"array<{_SPAN}>"))))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["at"], s["stop"])), ",")


def redact(docs: DataFrame, columns: list[str], mark: str = "[SECRET]", rate: float = 0.01) -> DataFrame:
    """docs with every secret span of their texts replaced by the mark; overlapping spans become one. n_chars follows
    the new text."""
    found = secret_spans(docs, rate).withColumn("all", F.array_sort(F.concat("base", "added"))).where(F.size("all") > 0)
    found = materialize(found.select("doc_id", "text_key", "all").distinct(), "secrets")
    keys = small_or_shuffled(found.select("doc_id", "text_key"))
    keyed = docs.select(*columns, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")).alias("d")
    same = lambda a, b: F.expr(f"{a}.doc_id <=> {b}.doc_id AND {a}.text_key = {b}.text_key")
    plain = keyed.join(keys.alias("s"), same("d", "s"), "left_anti").select(*columns)
    some = keyed.join(keys.alias("k"), same("d", "k"), "left_semi").alias("d").join(found.alias("s"), same("d", "s"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("d.text")

    def add(acc: Column, s: Column) -> Column:
        fresh = s["at"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["at"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), out.alias("out"))

    cut = F.aggregate(F.col("s.all"), start, add)
    some = some.withColumn("cut", cut).withColumn("new", F.concat(F.col("cut.out"), F.expr("substring(d.text, cut.at + 1)")))
    rest = [c for c in columns if c not in ("text", "n_chars")]
    some = some.select(F.col("new").alias("text"), F.length("new").cast("long").alias("n_chars"), *[F.col(f"d.{c}") for c in rest])
    return plain.unionByName(some.select(*columns))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", "added"))).alias("spans"))
