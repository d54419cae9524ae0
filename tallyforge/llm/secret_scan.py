"""Secret scans with DataFrame and SQL functions only.

Candidates are long runs of key characters with a digit or a change of case inside, and shorter values that are assigned
to names of secrets. A random forest, trained on labelled
findings, removes false positives: it looks at length, character transitions, dictionary coverage, the path around the
candidate and the words beside it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.blocks import BROADCAST_ROWS
from tallyforge.llm.common import save, table

KEY = r"A-Za-z0-9+/_\-"
#: Names whose assigned values are searched at shorter lengths, and what may stand between; of fixed widths, as they are looked back for.
NAMES = ("token", "secret", "api[ _-]key", "apikey", "access[ _-]key", "accesskey", "private[ _-]key", "client[ _-]key", "signing[ _-]key", "password", "passwd", "pwd", "credential", "credentials", "auth")
BETWEEN = ("[=:]", "[=:] ", " [=:] ", "[=:][\"'`]", "[=:] [\"'`]", " [=:][\"'`]", " [=:] [\"'`]", "[\"'`][=:][\"'`]", "[\"'`][=:] [\"'`]", "[\"'`] [=:] [\"'`]")
NAMED = "(?:" + "|".join(f"(?<=(?i:{n}){b})" for n in NAMES for b in BETWEEN) + ")"
#: A value of at least 8 characters after an assignment to a name, with a digit, a change of case or a sign inside; a quoted one may hold any sign.
INSIDE = r"(?:[0-9]|[a-z][A-Z]|[^A-Za-z0-9\s\"'`.,;:)])"
ASSIGNED = "|".join(rf"(?<=[{before}])(?=[^{out}]{{8}})(?=[^{out}]*{INSIDE}){NAMED}[^{out}]{{7,}}[^{out}.,:)\]}}]" for before, out in (("\"'`", r"\s\"'`"), (r"=:\s", r"\s\"'`&;<>")))
#: Else a run of at least 16 key characters that holds a digit or a lower-case letter before an upper-case one; = is padding at its end. A name before = is none.
RUN = rf"(?<![{KEY}])(?=[{KEY}]{{16}})(?=[{KEY}]*(?:[0-9]|[a-z][A-Z]))(?![{KEY}]+=[{KEY}\"'`])[{KEY}]+(?:={{1,2}}(?![{KEY}=]))?"
CANDIDATE = f"(?:{ASSIGNED}|{RUN})"
CONTEXT = 48
MASK = "[secret]"
#: Stands for a candidate while its text is split.
MARK = "\u0000"

#: Fixed word lists, in natural order.
DICTIONARY = (
    "access account active admin alpha assets auth authority avatar backup banner base beta bucket build button cache card cell center change chapter chart check "
    "child class client cloud code color column commit common config content control count create current data date default delete demo design detail device "
    "domain down draft dummy edit element email enable end error event example export factory false field file filter final first folder font footer form "
    "format frame function game group handler head health height here hidden home host html http icon image import index info input insert item java "
    "june july key label language large last layer layout left level library light line link list load local login main manager map master media member menu "
    "message method mobile model module name new node number object off open option order output page panel param parent part password path photo "
    "picture play plugin point post press price product profile project public query random read record region release remove report request resource response "
    "result right root row sample save school screen script search section select server service session set setting shadow side simple site size small "
    "sort source start state static status stop store string style submit summer support system tab table task team template test text theme thumb time title "
    "token tool top track trial true type update upload user utils value version video view web week welcome width window winter work world year your"
).split()
SECRET_WORDS = ("token", "secret", "api[ _-]?key", "access[ _-]?key", "private[ _-]?key", "client[ _-]?key", "passw(?:or)?d", "pwd", "credentials?", "bearer", "auth(?:orization)?", "signing[ _-]?key")
HARMLESS_WORDS = (
    "sha[0-9]*", "md5", "commit", "hash", "checksum", "digest", "uuid", "guid", "etag", "revision", "integrity", "fingerprint", "build", "version", "isbn", "serial", "order", "invoice", "card",
    "phone", "tel", "example", "sample", "placeholder", "base64", "image", "trace", "request[ _-]?id",
)
KEY_FORMATS = ("AKIA[0-9A-Z]{16}", "gh[pousr]_[A-Za-z0-9]{30,}", "sk-[A-Za-z0-9\\-_]{20,}", "xox[abprs]-[A-Za-z0-9-]{10,}", "eyJ[A-Za-z0-9_\\-]{10,}", "AIza[A-Za-z0-9_\\-]{30,}", "glpat-[A-Za-z0-9_\\-]{16,}")
PATH_WORDS = ("test", "tests", "example", "examples", "fixture", "fixtures", "mock", "mocks", "sample", "docs", "vendor", "assets", "static", "images")

FEATURES = ["length", "digits", "uppers", "lowers", "others", "hex", "variety", "transitions", "vowels", "coverage", "format", "in_path", "path_words", "extension", "assigned", "quoted", "secret_near", "secret_far", "harmless_near", "harmless_far"]
#: Findings that train() reads at most, those with the smallest hashes.
FIT_ROWS = 8000


def share(column: Column, chars: str) -> Column:
    return F.regexp_count(column, F.lit(f"[{chars}]")) / F.length(column)


def any_of(words: tuple[str, ...] | list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def with_features(rows: DataFrame) -> DataFrame:
    """Adds FEATURES, doubles, to rows with candidate, before, after and path (strings, not null)."""
    c, before, after, path = (F.col(x) for x in ("candidate", "before", "after", "path"))
    low, left = F.lower(c), F.lower(before)
    kinds = reduce(lambda x, p: F.regexp_replace(x, *p), [("[a-z]", "a"), ("[A-Z]", "B"), ("[0-9]", "0"), ("[^aB0]", "-")], c)
    covered = F.length(c) - F.length(F.regexp_replace(low, any_of(sorted(DICTIONARY, key=len, reverse=True)), ""))
    near = r"[\"'`\s]{0,3}(?:[:=]|=>|:=|is)?[\"'`\s]{0,3}$"
    made = {
        "length": F.log2(F.length(c)),
        "digits": share(c, "0-9"),
        "uppers": share(c, "A-Z"),
        "lowers": share(c, "a-z"),
        "others": share(c, r"^A-Za-z0-9"),
        "hex": c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "variety": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        "transitions": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / (F.length(c) - 1),
        "vowels": share(low, "aeiou"),
        "coverage": covered / F.length(c),
        "format": c.rlike(rf"^{any_of(KEY_FORMATS)}$"),
        "in_path": before.rlike(r"(?:[A-Za-z0-9._\-]/|://\S*|[?&]\w+=|@)$") | c.rlike(r"^/|/[A-Za-z]{3,}/"),
        "path_words": F.lower(F.concat(path, F.lit(" "), F.regexp_extract(before, r"(\S*)$", 1), c)).rlike(rf"(?:^|[^a-z]){any_of(PATH_WORDS)}(?:[^a-z]|$)"),
        "extension": after.rlike(r"^(?:\.[A-Za-z]{2,5}\b|@|\?)"),
        "assigned": before.rlike(r"(?:[:=]|=>|:=)[\"'`\s]{0,3}$"),
        "quoted": before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]"),
        "secret_near": left.rlike(any_of(SECRET_WORDS) + r"\w{0,6}" + near),
        "secret_far": left.rlike(any_of(SECRET_WORDS)),
        "harmless_near": left.rlike(any_of(HARMLESS_WORDS) + near) | low.rlike(any_of(("example", "sample", "placeholder", "your", "xxxx", "1234567"))),
        "harmless_far": F.concat(left, F.lower(after)).rlike(rf"\b{any_of(HARMLESS_WORDS)}\b"),
    }
    return rows.withColumns({k: v.cast("double") for k, v in made.items()})


def candidates(docs: DataFrame, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """docs with one row for each candidate: begin and end (characters, from 0), candidate, before, after and path.

    Whole texts are searched; a null text has no candidates and a null path is empty. Columns of docs that have one of
    these names are replaced, and the text column is dropped.
    """
    added = ["begin", "end", "candidate", "before", "after", "path"]
    src = docs.withColumns({"_text": F.col(text_col), "_path": F.coalesce(F.col(path_col).cast("string"), F.lit(""))}).drop(text_col, *added)
    src = src.where(F.col("_text").rlike(CANDIDATE))
    # gaps are split at a mark that the plain text does not hold, as split() would compile the long pattern for each row
    plain = F.translate("_text", MARK, "\ufffd")
    src = src.withColumns({"_found": F.regexp_extract_all(plain, F.lit(CANDIDATE), F.lit(0)), "_gaps": F.split(F.regexp_replace(plain, CANDIDATE, MARK), MARK, -1)})
    at = F.aggregate(
        F.sequence(F.lit(0), F.size("_found") - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, i: F.struct(
            (acc["at"] + F.length(F.get("_gaps", i)) + F.length(F.get("_found", i))).alias("at"),
            F.concat(acc["all"], F.array(acc["at"] + F.length(F.get("_gaps", i)))).alias("all"),
        ),
        lambda acc: acc["all"],
    )
    one = F.transform(
        at, lambda begin, i: F.struct(begin.alias("begin"), F.substring("_text", begin + 1, F.length(F.get("_found", i))).alias("candidate"), F.right(F.get("_gaps", i), F.lit(CONTEXT)).alias("before"), F.left(F.get("_gaps", i + 1), F.lit(CONTEXT)).alias("after"))
    )
    kept = [c for c in src.columns if c not in ("_found", "_gaps", "_path", "_text")]
    rows = src.select(*kept, F.col("_path").alias("path"), F.explode(one).alias("_one"))
    return rows.select(*kept, F.col("_one.begin").alias("begin"), (F.col("_one.begin") + F.length("_one.candidate")).alias("end"), "_one.candidate", "_one.before", "_one.after", "path")


#: Made-up findings: before, prefix, kind of value, its seed and size, joint, kind of tail, its seed and size, after, label.
#: Kinds: x hex, X upper-case hex, a letters and digits, A upper-case ones, b base64, d digits, u UUID, s slug, c camel case, w a word, n a number, - none.
PATTERNS = [
    ('token = "', "", "x", 30, 40, "", "-", 0, 0, '"', 1), ("api_key: '", "", "a", 31, 32, "", "-", 0, 0, "'", 1), ("secret=", "", "b", 32, 40, "", "-", 0, 0, "", 1), ('password = "', "", "a", 33, 18, "", "-", 0, 0, '"', 1),
    ("aws_access_key_id = ", "AKIA", "A", 21, 16, "", "-", 0, 0, "", 1), ("Authorization: Bearer ", "", "a", 34, 60, "", "-", 0, 0, "", 1), ("use ", "ghp_", "a", 35, 36, "", "-", 0, 0, " for", 1),
    ("client_secret='", "", "x", 36, 32, "", "-", 0, 0, "'", 1), ("export API_TOKEN=", "", "x", 37, 64, "", "-", 0, 0, "", 1), ("", "sk-", "a", 38, 48, "", "-", 0, 0, "", 1), ('private_key = "', "", "x", 39, 64, "", "-", 0, 0, '"', 1),
    ("pwd: ", "", "a", 40, 16, "", "-", 0, 0, ".", 1), ("the access token is ", "", "a", 41, 24, "", "-", 0, 0, "", 1),
    ("commit ", "", "x", 42, 40, "", "-", 0, 0, " by", 0), ("sha256:", "", "x", 43, 64, "", "-", 0, 0, "", 0), ("md5 = ", "", "x", 44, 32, "", "-", 0, 0, "", 0), ('<img src="/assets/', "", "x", 45, 32, "", "-", 0, 0, '.png"', 0),
    ("uuid ", "", "u", 1, 0, "", "-", 0, 0, "", 0), ("https://site.net/news/", "", "s", 11, 0, "", "-", 0, 0, "", 0), ("order number ", "", "d", 46, 16, "", "-", 0, 0, ".", 0), ("", "", "d", 47, 16, "", "-", 0, 0, "", 0),
    ("class ", "", "c", 15, 0, "", "-", 0, 0, " {", 0), ("", "", "c", 15, 0, "", "-", 0, 0, "(", 0), ("see ", "usr/lib/python3/", "w", 18, 0, "/file", "-", 0, 0, ".py", 0),
    ('token = "', "your-token-here-", "-", 0, 0, "", "n", 0, 1000, '"', 0), ('api_key = "', "EXAMPLE_KEY_1234567890", "-", 0, 0, "", "-", 0, 0, '"', 0), ("data:image/png;base64,", "", "b", 48, 80, "", "-", 0, 0, "", 0),
    ("checksum ", "", "x", 49, 64, "", "-", 0, 0, "", 0), ('integrity="sha512-', "", "b", 51, 80, "", "-", 0, 0, '"', 0), ("", "", "x", 52, 40, "", "-", 0, 0, "", 0), ("", "", "s", 11, 0, "", "-", 0, 0, ".", 0),
    ("build ", "2024-01-02-", "x", 53, 12, "", "-", 0, 0, "", 0), ("", "", "X", 54, 24, "", "-", 0, 0, "", 0), ("card ", "", "d", 55, 16, "", "-", 0, 0, "", 0),
    ('password = "', "", "a", 56, 12, "", "-", 0, 0, '"', 1), ("password: '", "", "a", 57, 7, "&", "a", 58, 9, "'", 1), ("db_password=", "", "a", 59, 10, "", "-", 0, 0, "", 1), ('"secret": "', "", "a", 70, 6, "!", "a", 71, 6, '"', 1),
    ("pwd=", "", "w", 19, 0, "-", "a", 72, 6, "", 1), ('password = "', "your-password-", "-", 0, 0, "", "n", 0, 100, '"', 0), ("token: ", "example-", "w", 20, 0, "", "n", 0, 10, "", 0),
]
FILLERS = ("the", "and", "report", "of", "summer", "is", "we", "find", "los", "para", "und", "nicht", "dans", "pour", "value", "note", "erle", "anthe")


def made_value(kind: Column, k: Column, size: Column) -> Column:
    """A value of a kind of PATTERNS by the hash of the row's id and a seed, of size characters where the kind has no shape of its own."""

    def keyed(sep: str, seed: Column) -> Column:
        return F.concat_ws(sep, seed, "id").cast("binary")

    def hexes(seed: Column) -> Column:
        return F.concat(F.sha2(keyed(":", seed), 256), F.sha2(keyed(";", seed), 256))

    letters = F.substring(F.regexp_replace(F.concat(*[F.base64(F.unhex(F.sha2(keyed(sep, k), 512))) for sep in "ab"]), "[+/=]", ""), F.lit(1), size)
    base64 = F.substring(F.base64(F.unhex(F.sha2(keyed("c", k), 512))), F.lit(1), size)
    digits = F.substring(F.concat(F.lit("4"), F.regexp_replace(F.concat(hexes(k), hexes(k + 50)), "[a-f]", "")), F.lit(1), size)
    uuid = F.concat_ws("-", *[F.substring(hexes(k + i), F.lit(1), F.lit(n)) for i, n in enumerate((8, 4, 4, 4, 12))])
    slug = F.concat_ws("-", *[filler(k + i) for i in range(4)], (F.col("id") % 900 + 100).cast("string"))
    camel = F.concat(F.initcap(filler(k)), F.initcap(filler(k + 1)), F.lit("Controller"), F.initcap(filler(k + 2)), F.lit("Factory"), (F.col("id") % 10).cast("string"))
    plain = F.substring(hexes(k), F.lit(1), size)
    return (
        F.when(kind == "x", plain).when(kind == "X", F.upper(plain)).when(kind == "a", letters).when(kind == "A", F.upper(letters)).when(kind == "b", base64).when(kind == "d", digits)
        .when(kind == "u", uuid).when(kind == "s", slug).when(kind == "c", camel).when(kind == "w", filler(k)).when(kind == "n", (F.col("id") % size).cast("string")).otherwise("")
    )


def filler(k: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in FILLERS]), F.pmod(F.xxhash64("id", k), F.lit(len(FILLERS))).cast("int"))


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """Findings (candidate, before, after, path, label) of candidates() in n made-up sentences, each with a secret or harmless value by turns of PATTERNS."""
    names = "which, start, prefix, kind, k, size, joint, tail, tail_k, tail_size, rest, of_value"
    quoted = lambda v: "'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else str(v)
    lines = ", ".join(f"({i}, {', '.join(map(quoted, p))})" for i, p in enumerate(PATTERNS))
    patterns = spark.sql(f"SELECT * FROM VALUES {lines} AS p({names})")
    rows = spark.range(0, n, 1, 4).join(F.broadcast(patterns), F.col("id") % len(PATTERNS) == F.col("which"))
    value = F.concat("prefix", made_value(F.col("kind"), F.col("k"), F.col("size")), "joint", made_value(F.col("tail"), F.col("tail_k"), F.col("tail_size")))
    # written between, as the expressions would else be planned again for each use of their columns
    made = save(rows.select("id", "start", "rest", "of_value", value.alias("value")), "values")

    def word(k: int) -> Column:
        return filler(F.lit(k))

    sentences = made.select(
        "value",
        F.col("of_value").cast("double").alias("of_value"),
        F.concat(F.concat_ws(" ", word(60), word(61), word(62), F.concat(word(63), F.lit(". ")), "start"), "value", "rest", F.lit(" "), word(64), F.lit(" "), word(65)).alias("text"),
        F.when(F.col("id") % 7 == 0, "src").otherwise("").alias("source"),
    )
    mine = F.col("candidate").contains(F.col("value")) | F.col("value").contains(F.col("candidate"))
    found = candidates(save(sentences, "sentences"))
    return save(found.select("candidate", "before", "after", "path", F.when(mine, F.col("of_value")).otherwise(0.0).alias("label")), "findings")


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=FEATURES, outputCol="_features")


def train(findings: DataFrame, trees: int = 16, depth: int = 5, seed: int = 11) -> RandomForestClassificationModel:
    """A forest on at most FIT_ROWS labelled findings: candidate, before, after, path and label (1 secret, 0 not).

    Findings with a null label or candidate are left out, other nulls are empty strings. Needs one finding at least.
    """
    text = {c: F.coalesce(c, F.lit("")) for c in ("before", "after", "path")}
    rows = findings.where("label is not null and length(candidate) > 1").withColumns(text).orderBy(F.xxhash64("candidate", "before", "after")).limit(FIT_ROWS)
    # features are computed once, side by side; the fit passes over them several times
    data = save(with_features(rows.repartition(8)).select(*FEATURES, "label"), "features")
    data = assembler().transform(data).select("_features", "label")
    return RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=64).fit(data)


def scan(docs: DataFrame, model: RandomForestClassificationModel, text_col: str = "text", path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """candidates() of docs with score (the forest's share for secrets) and is_secret (score of at least threshold)."""
    rows = assembler().transform(with_features(candidates(docs.drop("score", "is_secret", *FEATURES), text_col, path_col)))
    model = model.copy().setPredictionCol("_class").setProbabilityCol("_share").setRawPredictionCol("_raw")
    scored = model.transform(rows).withColumn("score", F.get(vector_to_array("_share"), F.lit(1)))
    return scored.drop("_features", "_class", "_share", "_raw", *FEATURES).withColumn("is_secret", F.col("score") >= threshold)


def redact(docs: DataFrame, model: RandomForestClassificationModel, text_col: str = "text", path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """docs with each secret of their texts replaced by MASK; all rows stay, in the same columns.

    Spans are found once for each different text and path and joined by their hash, so repeated rows are scanned
    together. Null texts stay null.
    """
    key = F.sha2(F.concat_ws("\u0000", F.col(path_col).cast("string"), F.col(text_col)).cast("binary"), 256)
    keyed = docs.withColumn("_key", key)
    distinct = keyed.select("_key", F.col(text_col).alias("text"), F.col(path_col).alias("source")).where(F.col("text").rlike(CANDIDATE)).dropDuplicates(["_key"])
    found = scan(distinct, model, threshold=threshold).where("is_secret").groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("_spans"))
    found = save(found, "secrets")
    n_spans = found.agg(F.coalesce(F.sum(F.size("_spans")), F.lit(0))).head()[0]
    spans = F.broadcast(found) if n_spans <= BROADCAST_ROWS else found
    text = F.col(text_col)
    done = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["begin"] - acc["at"]), F.lit(MASK)).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return keyed.join(spans, "_key", "left").withColumn(text_col, F.when(F.col("_spans").isNull(), text).otherwise(done)).select(*docs.columns)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(labelled_findings(spark))
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), model)
    return found.select("doc_id", "begin", "end", F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), "score", "is_secret")
