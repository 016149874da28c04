"""Secret scans: candidate strings in texts, and a random forest against false ones.

Candidates are runs of at least 16 characters of keys and hashes that are no plain
lower-case word, and whatever is assigned to a telling name (``password = ...``) from
six characters on. Each is described by its length, its character transitions (how
unlikely its letters follow each other in words of the dictionary, and changes of kind), how
much of its letters a dictionary covers, whether it stands in a path, and its
neighbouring words. The forest learns from labelled findings which of them are
secrets: made ones of common shapes, and those of the documents that rules label
without doubt. All of it runs as DataFrame expressions and MLlib; findings are named
by their hash, so that a report does not spread what it found.
"""

from __future__ import annotations

import json
import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmesh.llm.columns import ascii_lower
from driftmesh.storage import materialize

CANDIDATE = r"(?=.[a-z]*[A-Z0-9+/_=\-])[A-Za-z0-9+/_=\-]{16,}"
#: Labelled findings of each kind that the forest is fitted on at most: those of smallest hash.
MAX_LABELLED = 20_000
#: Words that introduce a secret, and words that belong to harmless strings.
TELLING = "token|secret|passw|pwd|api|key|auth|bearer|credential|private|access"
HARMLESS = "commit|sha|md5|digest|version|release|build|file|image|example|sample|id|ref|checksum|order|phone|tel"
#: A word that assigns a value to a telling name, and what may stand between name and value.
ASSIGNED = rf"(?i)^[\"'(]*[a-z0-9_.\-]*({TELLING})[a-z0-9_.\-]*[\"']?[:=]+[\"']?[^\s\"':=]{{6}}"
NAME = rf"(?i)({TELLING})[a-z0-9_.\-]*[\"']?"
FEATURES = [
    "length", "digits", "uppers", "hexes", "variety", "class_changes", "vowel_changes", "surprise", "repeats", "covered", "in_path", "told", "harmless", "assigns", "others", "quoted", "next_length",
]


def _told(i: Column) -> Column:
    """Whether the word at ``i`` has, or is, a value assigned to a telling name."""
    word, before, earlier = (F.coalesce(F.get("words", i - k), F.lit("")) for k in (0, 1, 2))
    alone = before.rlike("^(=|:|:=|=>|is)$") & earlier.rlike(f"{NAME}$")
    return (F.char_length(word) >= 6) & (word.rlike(ASSIGNED) | before.rlike(f"{NAME}[:=]+$") | alone)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos (of the word), nth (in the word), word, candidate, before2, before, after, assigned."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.col(id_col).alias("id"), F.split(text, r"[\x20\x09-\x0D]+").alias("words"), text.rlike(f"(?i)({TELLING})").alias("tells"))
    long = lambda i: (F.char_length(F.get("words", i)) >= 16) & F.get("words", i).rlike(CANDIDATE)
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: long(i) | (F.col("tells") & _told(i)))
    around = F.transform(
        at,
        lambda i: F.struct(
            i.alias("pos"),
            F.get("words", i).alias("word"),
            F.get("words", i - 2).alias("before2"),
            F.get("words", i - 1).alias("before"),
            F.get("words", i + 1).alias("after"),
            (F.col("tells") & _told(i)).alias("assigned"),
        ),
    )
    return found_in(split.select("id", F.explode(around).alias("f")).select("id", "f.*"))


def found_in(words: DataFrame) -> DataFrame:
    """``words`` with nth and candidate: the assigned value, or all long runs of a word."""
    value = F.regexp_extract(F.regexp_replace("word", rf"(?i)^[\"'(]*[a-z0-9_.\-]*({TELLING})[a-z0-9_.\-]*[\"']?[:=]+", ""), "^[\"'`(\\[{<]*([^\"'`)\\]}>,;]{6,})", 1)
    runs = F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0))
    picked = F.when(F.col("assigned") & (value != ""), F.array(value)).otherwise(runs)
    return words.select("*", F.posexplode(picked).alias("nth", "candidate"))


def _share(candidate: Column, pattern: str) -> Column:
    return F.regexp_count(candidate, F.lit(pattern)) / F.char_length(candidate)


def transition_costs(dictionary: DataFrame) -> list[float]:
    """Minus the log probability of letter b after letter a in the dictionary's words, at 26 a + b.

    Counts start at one. The table has 676 numbers, whatever the dictionary.
    """
    letters = F.split("entry", "")
    codes = lambda begin: F.transform(F.slice(letters, begin, F.greatest(F.size(letters) - 1, F.lit(0))), lambda c: F.ascii(c) - 97)
    pairs = dictionary.filter(F.col("entry").rlike("^[a-z]+$")).select(F.explode(F.zip_with(codes(1), codes(2), lambda a, b: a * 26 + b)).alias("at"))
    seen = {r["at"]: r["count"] for r in pairs.groupBy("at").count().collect()}
    after = [26 + sum(seen.get(26 * a + b, 0) for b in range(26)) for a in range(26)]
    return [math.log(after[at // 26] / (seen.get(at, 0) + 1)) for at in range(676)]


def _surprise(low: Column, costs: list[float]) -> Column:
    """The mean cost of the steps from letter to letter; that of random letters where there is none."""
    chars, table = F.split(low, ""), F.lit(costs)
    letter = lambda c: c.between("a", "z")
    rest = F.greatest(F.size(chars) - 1, F.lit(0))
    step = lambda a, b: F.when(letter(a) & letter(b), F.get(table, (F.ascii(a) - 97) * 26 + F.ascii(b) - 97))
    steps = F.filter(F.zip_with(F.slice(chars, 1, rest), F.slice(chars, 2, rest), step), lambda v: v.isNotNull())
    return F.coalesce(F.try_divide(F.aggregate(steps, F.lit(0.0), lambda total, v: total + v), F.size(steps)), F.lit(sum(costs) / len(costs)))


def describe(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``found`` with the feature columns; ``dictionary`` has one column, entry.

    The dictionary is bounded by the vocabulary it is from and is broadcast.
    """
    costs = transition_costs(dictionary)
    c, low = F.col("candidate"), ascii_lower(F.col("candidate"))
    near = ascii_lower(F.concat_ws(" ", "before2", "before"))
    row = F.struct(*[F.col(n) for n in found.columns])
    runs = found.select(row.alias("row"), F.explode_outer(F.regexp_extract_all(low, F.lit("[a-z]{3,}"), F.lit(0))).alias("entry"))
    known = runs.join(F.broadcast(dictionary.select("entry", F.lit(1).alias("known"))), "entry", "left")
    covered = known.groupBy("row").agg(F.sum(F.when(F.col("known") == 1, F.char_length("entry")).otherwise(0)).alias("letters")).select("row.*", "letters")
    features = {
        "length": F.char_length(c),
        "digits": _share(c, "[0-9]"),
        "uppers": _share(c, "[A-Z]"),
        "hexes": _share(c, "[0-9a-fA-F]"),
        "variety": F.size(F.array_distinct(F.split(c, ""))) / F.least(F.char_length(c), F.lit(64)),
        "class_changes": _share(c, "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])"),
        "vowel_changes": _share(low, "(?<=[aeiou])(?=[a-z&&[^aeiou]])|(?<=[a-z&&[^aeiou]])(?=[aeiou])"),
        "surprise": _surprise(low, costs),
        "repeats": _share(c, r"(.)(?=\1)"),
        "covered": F.col("letters") / F.char_length(c),
        "in_path": (F.instr("word", "://") > 0) | F.col("word").rlike(r"^[^\"']*/[^\"']*/") | F.col("word").rlike(r"\.[a-z]{2,4}$"),
        "told": near.rlike(TELLING) | ascii_lower("word").rlike(f"^[\"'(]*({TELLING})"),
        "harmless": near.rlike(f"\\b({HARMLESS})"),
        "assigns": F.col("assigned") | F.coalesce(F.col("before").rlike("[=:]$"), F.lit(False)) | F.col("word").rlike("^[A-Za-z_]+[=:]"),
        "others": _share(c, "[^A-Za-z0-9]"),
        "quoted": F.col("word").rlike("[\"'`]"),
        "next_length": F.coalesce(F.char_length("after"), F.lit(0)),
    }
    return covered.select(*found.columns, *[features[n].cast("double").alias(n) for n in FEATURES])


def labelled_findings(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """Findings with a label (1: a secret), made by rule.

    Keys, tokens and passwords of common shapes with and without a telling word before
    them, against card numbers, dates, hashes in paths, identifiers of words, and
    placeholders where a secret would stand.
    """
    h = F.sha2(F.concat(F.lit("finding:"), F.col("id").cast("string")), 256)
    bits = lambda a, n: F.conv(F.substring(h, a, n), 16, 10).cast("long")
    pick = lambda at, *values: F.get(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), (bits(at, 4) % len(values)).cast("int"))
    name = pick(1, "report", "holiday", "invoice", "session", "picture", "archive", "summary", "weather")
    other = pick(5, "final", "draft", "public", "winter", "update", "large", "north", "second")
    mixed = F.translate(F.base64(F.unhex(F.sha2(h, 256))), "+/=", "xyz")
    letters = F.translate(mixed, "0123456789", "QwErTyUiOp")
    number = F.substring(F.regexp_replace(F.concat(h, F.sha2(h, 256)), "[a-f]", ""), 1, 16)
    mark = pick(29, "!", "#", "$", "%", "@", "?")
    keys = [F.substring(h, 3, 40), F.substring(h, 3, 32), h, F.substring(mixed, 1, 32), F.concat(F.lit("AKIA"), F.upper(F.substring(mixed, 1, 16))), F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), F.upper(F.substring(h, 5, 40)), F.substring(letters, 1, 24), F.concat(F.lit("AKIA"), F.upper(F.substring(letters, 1, 16)))]
    passwords = [F.concat(F.substring(mixed, 1, 7), mark, F.substring(mixed, 9, 3)), F.concat(F.initcap(name), F.substring(number, 1, 4), mark), F.concat(name, F.lit("-"), other, F.lit("-"), F.reverse(name), F.lit("-"), F.substring(letters, 1, 4)), F.substring(mixed, 1, 10)]
    harmless = pick(
        9,
        number,
        F.concat(name, F.lit("-"), other, F.lit("-20"), F.substring(number, 1, 6)),
        F.concat(F.lit("https://example.org/commit/"), F.substring(h, 3, 40)),
        F.concat(F.lit("20"), F.substring(number, 1, 2), F.lit("-01-02T03-04-05-"), F.substring(number, 3, 3)),
        F.concat(F.lit("xxxxxxxxxxxx"), F.substring(number, 1, 4)),
        F.concat(name, F.lit("_"), other, F.lit("_image_"), F.substring(number, 1, 4), F.lit(".png")),
        F.concat(F.lit("/usr/share/"), name, F.lit("/"), other, F.substring(number, 1, 3)),
        F.concat(F.initcap(name), F.initcap(other), F.initcap(name)),
        F.concat(F.upper(name), F.lit("_"), F.upper(other), F.lit("_"), F.upper(name)),
    )
    placeholder = pick(9, "changeme", "your_password_here", "<password>", "xxxxxxxxxx", "${PASSWORD}", "example", "required", F.concat(F.lit("config."), name), F.concat(name, F.lit("_"), other))
    is_secret = bits(13, 2) % 2 == 0
    told = bits(15, 2) % 10 < 7
    short = told & (bits(27, 2) % 3 == 0)
    lead = pick(17, "token", "api_key", "password", "secret", "auth_token")
    plain = pick(21, "the", "of", "with", "order", "commit", "file", "see")
    secret = F.when(short, pick(9, *passwords)).otherwise(pick(9, *keys))
    value = F.when(is_secret, secret).when(short, placeholder).otherwise(harmless)
    leads = (is_secret & told) | (~is_secret & short)
    words = spark.range(rows).select(
        F.lit(-1).cast("long").alias("row"),
        F.col("id").cast("int").alias("pos"),
        F.when(bits(25, 2) % 3 == 0, value).when(is_secret | short, F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value).alias("word"),
        F.when(leads, lead).otherwise(plain).alias("before2"),
        F.when(leads, F.lit("=")).otherwise(other).alias("before"),
        name.alias("after"),
        leads.alias("assigned"),
        is_secret.cast("double").alias("label"),
    )
    return found_in(words).filter("nth = 0")


def clear_findings(described: DataFrame) -> DataFrame:
    """Findings of documents with a label where rules leave no doubt; the others are left out.

    A secret: assigned to a telling name and a long mix of letters and digits without
    words. None: a number, or a string in a path or address that no such name stands by.
    """
    key = (F.col("assigns") == 1) & (F.col("told") == 1) & (F.col("length") >= 20) & (F.col("covered") < 0.3) & F.col("digits").between(0.05, 0.9) & (F.col("others") < 0.2)
    plain = (F.col("told") == 0) & (F.col("assigns") == 0) & ((F.col("digits") > 0.95) | (F.col("in_path") == 1))
    return described.withColumn("label", F.when(key, 1.0).when(plain, 0.0)).filter("label IS NOT NULL")


def read_dictionary(spark: SparkSession, path: str, least: int = 3) -> DataFrame:
    """entry: the lower-case words of a vocabulary file, read on the driver."""
    with open(path, encoding="utf-8") as file:
        entries = json.load(file)["model"]["vocab"]
    plain = {e.lstrip("Ġ").lower() for e in entries if e.startswith("Ġ")}
    words = sorted(e for e in plain if len(e) >= least and e.isascii() and e.isalpha())
    text = " ".join(words)
    return spark.range(1).select(F.explode(F.split(F.lit(text), " ")).alias("entry"))


def train(described: DataFrame, trees: int = 24, depth: int = 7, seed: int = 7) -> RandomForestClassificationModel:
    """A forest fitted on described findings with a column label.

    The rows, bounded by their makers, are put in one order, as a forest depends on it.
    """
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described)
    ordered = rows.select("features", "label", *FEATURES).coalesce(1).sortWithinPartitions("label", *FEATURES)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(ordered.select("features", "label"))


def scan_secrets(
    docs: DataFrame, dictionary: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED
) -> DataFrame:
    """One row per candidate: id, pos, nth, candidate, probability, is_secret.

    ``findings`` are labelled ones (word, candidate, before2, before, after, assigned,
    label), of which the ``max_labelled`` of smallest hash are used; without, those of
    ``labelled_findings``. As many of ``clear_findings`` join them. Null and empty texts
    have no candidate; null ids are scanned like any others; a text is read whole,
    however long. A finding is known by id, position and neighbours, so equal rows of
    ``docs`` give their findings once; ties in probability need no order.
    """
    made = labelled_findings(docs.sparkSession) if findings is None else findings
    described = materialize(describe(candidates(docs, id_col, text_col), dictionary), "described-findings")
    some = lambda rows: rows.orderBy(F.xxhash64("candidate", "word", "before", "after"), "candidate", "pos").limit(max_labelled).select("label", *FEATURES)
    forest = train(some(describe(made, dictionary)).unionAll(some(clear_findings(described))))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described)
    judged = forest.transform(rows).withColumn("probability", F.round(vector_to_array("probability")[1], 6))
    return judged.select(F.col("id").alias(id_col), "pos", "nth", "candidate", "probability", (F.col("probability") >= threshold).alias("is_secret"))
