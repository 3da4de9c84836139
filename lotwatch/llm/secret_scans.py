"""Secret scans: candidate strings, kept or dismissed by a random forest.

Native throughout (Spark SQL and Spark ML).  A candidate is a run of 16 or more
key characters, a value of 8 or more that something is assigned (quoted, or
with a letter and a digit), or the password in a url.  The forest sees its
length and characters, how likely its transitions between characters are in the
corpus's own words, how much of it these words cover, path marks around it,
whether it starts as issued keys do, and how much more often the words beside
it stand beside secrets than beside other strings.

It is trained on labelled findings: given ones, or planted ones, whose labels
come from how they were made: secrets are assigned to a name of secrets, stand
in a url or start as issued keys do; hashes and numbers that stand alone or
bear names of their own, coded prose, stand-ins and references are none.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.llm.common import cut, once, table, words

RUN = "[A-Za-z0-9+/_=-]{16,}"
QUOTED = "[\"'`]([^\"'`\\x20\\x09-\\x0D]{8,})[\"'`]"
#: What may be a plain assigned value, with a letter and a digit.
PLAIN_VALUE = "(?=[^\\x20\\x09-\\x0D]*[0-9])(?=[^\\x20\\x09-\\x0D]*[A-Za-z])([^\"'`\\x20\\x09-\\x0D,;()<>{}\\[\\]]{8,})"
#: A value that follows its name in one word; a url's scheme is no name.
INSIDE = f"[=:](?!//){PLAIN_VALUE}"
URL_PASSWORD = "://[^/@:\\x20\\x09-\\x0D]*:([^/@\\x20\\x09-\\x0D]{4,})@"
#: What a text with a candidate holds.
HELD = f"{RUN}|[=:][\\x20\\x09-\\x0D]*(?:{QUOTED}|(?!//){PLAIN_VALUE})|{URL_PASSWORD}"
#: Labelled findings that the forest is fitted on, at most so many of each label, the smallest by a hash.
MOST_LABELLED = 5000
PLANTED = 8000
#: Words of the corpus that count as its dictionary recur so often, and make up so much of all words that do; words beside findings that are told apart, those that labels differ on most.
RECURRING, SHARE, NEIGHBOURS = 5, 2e-6, 200
TREES, DEPTH, SEED = 30, 8, 7
CHUNK = 1024
MASK = "[SECRET]"
FEATURES = ("length", "changes", "digits", "uppers", "distinct", "transitions", "covered", "path", "neighbours", "assigned", "quoted", "issued")
# How issued keys start.
ISSUED = ["AKIA", "ASIA", "ghp_", "gho_", "ghs_", "glpat-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza", "npm_", "pypi-", "SG.", "hf_", "eyJhbGci"]
# Fixed values for planting: names that secrets have, names that hashes, numbers and plain settings have, what hashes and numbers stand behind, and what stands in for a secret.
NAMES = ["token", "secret", "password", "passwd", "pwd", "pass", "api_key", "apikey", "access_key", "private_key", "auth_token", "client_secret", "credential", "key", "secret_key", "passphrase"]
HASHES = ["commit", "sha1", "sha256", "md5", "checksum", "revision", "digest", "etag", "uuid", "request", "id", "build", "hash", "integrity", "fingerprint", "signature", "trace", "session"]
NUMBERS = ["parcel", "tracking", "order", "invoice", "isbn", "iban", "phone", "serial", "ticket", "account", "flight", "number", "shipment"]
SETTINGS = ["version", "model", "host", "user", "date", "size", "format", "file", "path", "url", "name", "class", "release", "region", "image", "at", "see", "email"]
CODED = ["data", "body", "content", "payload", "attachment", "message", "text", "encoded"]
BEHIND = ["in", "at", "commit", "merged", "checkout", "from", "to", "see", "since", "fixed", "reverts", "picked", "of", "and", "the", "deployed", "tag", "by", "was"]
STAND_INS = ["your_api_key_here", "replace_with_token1", "changeme_changeme", "example_password_1", "xxxxxxxxxxxxxxxxxxxx", "put-your-secret-here", "<your-access-token>", "not_a_real_secret", "${SECRET_FROM_ENV1}", "os.environ[TOKEN1]", "insert-password-123"]
PLAIN = ["the", "and", "with", "for", "value", "from", "this", "that", "und", "der", "les", "pour", "que", "con"]


def ahead(word: Column, finding: Column) -> Column:
    """What stands before a finding in its word."""
    return F.left(word, F.position(finding, word) - 1)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, copy (a hash of the text), word_index, finding and its context of every candidate in docs."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).filter(F.col("text").rlike(HELD))
    rows = rows.select("doc_id", F.unhex(F.md5("text")).alias("copy"), once(words(F.col("text"))).alias("words"))
    w = F.col("words")
    held = lambda i: F.get(w, i).rlike(f"{RUN}|{QUOTED}|{INSIDE}|{URL_PASSWORD}") | (F.coalesce(F.get(w, i - 1), F.lit("")).rlike("[=:]$") & F.get(w, i).rlike(f"^{PLAIN_VALUE}"))
    places = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (F.length(F.get(w, i)) >= 8) & held(i))
    near = F.transform(places, lambda i: F.struct(i.alias("word_index"), F.get(w, i - 2).alias("before2"), F.get(w, i - 1).alias("before"), F.get(w, i).alias("word"), F.get(w, i + 1).alias("after")))
    found = rows.select("doc_id", "copy", once(near).alias("near")).select("doc_id", "copy", F.explode("near").alias("c")).select("doc_id", "copy", "c.*")
    return found.withColumn("finding", F.explode(findings_in(F.col("before"), F.col("word")))).select("doc_id", "copy", "word_index", "before2", "before", "word", "after", "finding")


def findings_in(before: Column, word: Column) -> Column:
    """The candidates in a word: a url's password, a quoted value that something is assigned, a plain one, or else its runs."""
    before = F.coalesce(before, F.lit(""))
    password = F.regexp_extract(word, URL_PASSWORD, 1)
    quoted = F.regexp_extract(word, QUOTED, 1)
    assigned = F.concat_ws(" ", before, ahead(word, quoted)).rlike("[=:] *[\"'`]$")
    plain = F.regexp_extract(word, INSIDE, 1)
    after = F.when(before.rlike("[=:]$"), F.regexp_extract(word, f"^{PLAIN_VALUE}", 1)).otherwise("")
    one = lambda c: F.array(F.regexp_replace(c, "[.!?]$", ""))
    runs = F.regexp_extract_all(word, F.lit(f"({RUN})"), F.lit(1))
    return F.when(password != "", F.array(password)).when((quoted != "") & assigned, F.array(quoted)).when(plain != "", one(plain)).when(after != "", one(after)).otherwise(runs)


def dictionary(docs: DataFrame) -> DataFrame:
    """word, n of the runs of 3 to 24 letters that recur in the corpus, whatever its size; counted in full, never collected."""
    runs = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,24}"), F.lit(0))).alias("word"))
    recurring = cut(runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= RECURRING))
    return recurring.join(F.broadcast(recurring.agg(F.sum("n").alias("all")))).filter(F.col("n") >= SHARE * F.col("all")).drop("all")  # one row


def code(c: Column) -> Column:
    """1 to 26 for letters, 0 for all else."""
    a = F.ascii(F.lower(c))
    return F.when(a.between(97, 122), a - 96).otherwise(0)


def transitions(known: DataFrame) -> DataFrame:
    """One row with the log-probability of each of 27 x 27 transitions, by code, in the dictionary's words."""
    spelt = known.select("n", F.concat(F.lit("."), F.col("word"), F.lit(".")).alias("w"))
    pairs = spelt.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: code(F.substring("w", i, F.lit(1))) * 27 + code(F.substring("w", i + 1, F.lit(1))))).alias("pair"))
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    grid = known.sparkSession.range(27 * 27).select(F.col("id").cast("int").alias("pair")).join(counts, "pair", "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    totals = grid.groupBy(F.floor(F.col("pair") / 27).alias("first")).agg(F.sum("n").alias("all"))
    logs = grid.withColumn("first", F.floor(F.col("pair") / 27)).join(totals, "first").select("pair", F.log(F.col("n") / F.col("all")).alias("log"))
    return cut(logs.agg(F.transform(F.sort_array(F.collect_list(F.struct("pair", "log"))), lambda x: x["log"]).alias("logs")).coalesce(1))


def beside(lead: Column) -> Column:
    """The words beside a finding, as what they have of letters."""
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]+", "")
    return F.array_distinct(F.filter(F.array(plain(F.col("before2")), plain(F.col("before")), plain(lead), plain(F.col("after"))), lambda x: x != ""))


def described(found: DataFrame, known: DataFrame, logs: DataFrame) -> DataFrame:
    """found with all features but `neighbours`, and `beside`, the words that it comes from."""
    f, n = F.col("finding"), F.length("finding").cast("double")
    share = lambda pattern: (n - F.length(F.regexp_replace(f, pattern, ""))) / n
    shape = f
    for kind, pattern in (("a", "[a-z]+"), ("A", "[A-Z]+"), ("0", "[0-9]+")):
        shape = F.regexp_replace(shape, pattern, kind)
    lead = ahead(F.col("word"), f)
    before = F.concat_ws(" ", F.coalesce("before", F.lit("")), lead)
    # Characters are taken apart some at a time (each part with the next one's first), so that a blob of megabytes makes no array of them.
    chunks = F.regexp_extract_all(f, F.lit(f"(?=([\\s\\S]{{1,{CHUNK + 1}}}))[\\s\\S]{{1,{CHUNK}}}"), F.lit(1))

    def likely(chunk: Column) -> Column:
        codes = F.transform(F.split(chunk, ""), code)
        steps = F.zip_with(codes, F.slice(codes, F.lit(2), F.length(chunk)), lambda x, y: F.coalesce(F.get("logs", x * 27 + y), F.lit(0.0)))
        return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)

    mean = F.aggregate(F.transform("chunks", likely), F.lit(0.0), lambda a, x: a + x) / F.greatest(n - 1, F.lit(1.0))
    letters = F.array_distinct(F.flatten(F.transform("chunks", lambda c: F.array_distinct(F.split(c, "")))))
    # Fragments, as in camelCase, that the dictionary has: joined, as it grows with the corpus.
    parts = found.select("finding").distinct().select("finding", F.explode(F.regexp_extract_all(f, F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0))).alias("part")).withColumn("word", F.lower("part"))
    covered = cut(parts.join(known.select("word"), "word").groupBy("finding").agg(F.sum(F.length("part")).alias("in_words")))
    rows = found.join(covered, "finding", "left").join(F.broadcast(logs))  # one row
    rows = rows.withColumn("chunks", once(chunks)).withColumns(
        {
            "length": n,
            "changes": F.length(shape) / n,
            "digits": share("[0-9]+"),
            "uppers": share("[A-Z]+"),
            "distinct": F.size(letters) / n,
            "transitions": mean,
            "covered": F.coalesce(F.col("in_words"), F.lit(0)) / n,
            "path": (F.length("word") - F.length(F.translate("word", "/.:@\\", ""))).cast("double"),
            "beside": beside(lead),
            "assigned": before.rlike("[=:] *[\"'`]?$").cast("double"),
            "quoted": F.col("word").rlike("[\"'`]").cast("double"),
            "issued": f.rlike("^(?:" + "|".join(x.replace(".", "\\.") for x in ISSUED) + ")").cast("double"),
        }
    )
    return rows.drop("chunks", "logs", "in_words")


def neighbours(labelled: DataFrame) -> DataFrame:
    """One row: the log-odds of a secret for each of the words beside labelled findings that tell most."""
    seen = labelled.select("label", F.explode("beside").alias("w")).groupBy("w").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    top = seen.orderBy(F.desc(F.abs(F.col("p") - F.col("q"))), "w").limit(NEIGHBOURS).withColumn("odds", F.log((F.col("p") + 1) / (F.col("q") + 1)))
    return cut(top.agg(F.map_from_entries(F.collect_list(F.struct("w", "odds"))).alias("odds")).coalesce(1))


def weighed(rows: DataFrame, odds: DataFrame) -> DataFrame:
    """rows (beside) with `neighbours`, the sum of the log-odds of the words beside."""
    rows = rows.join(F.broadcast(odds))  # one row
    total = F.aggregate(F.transform("beside", lambda w: F.coalesce(F.try_element_at("odds", w), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("neighbours", total).drop("odds", "beside")


def planted(spark: SparkSession, known: DataFrame, n: int = PLANTED, seed: int = SEED) -> DataFrame:
    """n made findings with their context and label, half of them secrets: parts, then names and values of each kind, then how they are written."""

    def number(k: int, most: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(most)).cast("int")

    def pick(values: list, k: int) -> Column:
        return F.get(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), number(k, len(values)))

    def word(k: int) -> Column:
        return F.get("common", F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.size("common")).cast("int"))

    def first(c: str, k: int, least: int, more: int) -> Column:
        return F.substring(c, F.lit(1), F.lit(least) + number(k, more))

    made = F.concat_ws("/", "id", F.lit(seed))
    common = known.orderBy(F.desc("n"), "word").limit(300).agg(F.collect_list("word").alias("common"))
    named = {*NAMES, *HASHES, *NUMBERS, *CODED}
    rows = spark.range(n, numPartitions=1).join(F.broadcast(common))  # one row
    rows = rows.withColumn("common", F.array_except(F.concat("common", F.array(*map(F.lit, PLAIN))), F.array(*map(F.lit, sorted(named)))))
    mixed = F.translate(F.base64(F.unhex(F.sha2(F.concat(made, F.lit("x")), 512))), "\r\n", "")
    rows = cut(rows.select("id", F.sha2(made, 512).alias("hexes"), mixed.alias("mixed"), F.translate(mixed, "+/=", "kQ7").alias("letters"), F.translate(F.sha2(made, 512), "abcdef", "123456").alias("digits"), *[word(i).alias(f"w{i}") for i in range(1, 9)]))

    w = [f"w{i}" for i in range(1, 9)]
    part = lambda c, at, n: F.substring(c, at, n)
    values = {
        "hash": pick([part("hexes", 1, 40), part("hexes", 1, 32), part("hexes", 1, 64), first("hexes", 33, 16, 12), F.concat_ws("-", part("hexes", 1, 8), part("hexes", 9, 4), part("hexes", 13, 4), part("hexes", 17, 4), part("hexes", 21, 12)), F.concat(pick(["sha384-", "sha512-", "sha256-"], 30), first("mixed", 31, 44, 20))], 1),
        "issued": F.concat(pick(ISSUED, 37), first("letters", 38, 16, 24)),
        "password": F.concat(part("w1", 1, 7), pick(["", "!", "$", "_", "X"], 34), first("digits", 35, 1, 4), first("letters", 36, 3, 5)),
        "random": pick([first("mixed", 39, 32, 20), first("letters", 40, 18, 24), first("letters", 41, 9, 6), part("hexes", 1, 40), part("hexes", 1, 32), part("hexes", 1, 64)], 42),
        "prose": F.regexp_replace(F.base64(F.encode(F.concat_ws(" ", *w), "utf-8")), "[\r\n]", ""),
        "parcel": pick([F.concat(F.lit("1Z"), F.upper(part("hexes", 1, 6)), part("digits", 1, 10)), first("digits", 43, 16, 6), F.concat(F.upper(part("hexes", 1, 2)), part("digits", 1, 20)), F.concat_ws("-", part("digits", 1, 4), part("digits", 5, 8), part("hexes", 1, 6))], 44),
        "setting": pick([F.concat("w1", part("digits", 1, 3)), F.concat_ws(".", part("digits", 1, 1), part("digits", 2, 2), F.concat(part("digits", 4, 1), F.lit("-rc"), part("digits", 5, 1))), F.concat(F.lit("2024-0"), part("digits", 1, 1), F.lit("-1"), part("digits", 2, 1), F.lit("T04:11")), F.concat("w2", part("digits", 1, 1), F.lit(".example.org:8080")), F.concat("w1", F.lit("@"), "w2", part("digits", 1, 2), F.lit(".example"))], 45),
        "words": pick([F.concat(*w[:5]), F.upper(F.concat(*w[:5])), F.concat("w1", *[F.initcap(x) for x in w[1:5]]), *[F.concat_ws(x, *w[:5]) for x in "_-/."], F.concat(F.lit("/"), F.concat_ws("/", *w[:4], part("digits", 1, 4)))], 62),
        "etag": first("letters", 56, 18, 10),
        "stand_in": pick(STAND_INS, 67),
        "run": F.repeat(pick(["=", "-", "_", "a", "0", "x"], 68), number(8, 30) + 16),
    }
    rows = cut(rows.select("id", "w1", "w2", "w3", "w4", *[v.alias(k) for k, v in values.items()]))
    # label, value, and the names that it may be given (none: it stands alone, behind one of the words, if there are any).
    kinds = [
        *[(1, v, NAMES, True) for v in ("random", "random", "random", "password", "password", "issued")], (1, "issued", [], False), (1, "password", [], None), (1, "etag", ["Bearer", "Basic", "Token"], False),
        *[(0, "hash", BEHIND, False), (0, "hash", [], False), (0, "hash", HASHES, True), (0, "etag", HASHES, True)], *[(0, "prose", CODED, g) for g in (True, False)], *[(0, "parcel", NUMBERS, g) for g in (True, False)],
        (0, "words", [], False), (0, "words", SETTINGS, True), (0, "setting", SETTINGS, True), (0, "setting", SETTINGS, True), (0, "stand_in", NAMES, True), (0, "words", NAMES, True), (0, "run", [], False),
    ]
    yes, no = [k for k in kinds if k[0]], [k for k in kinds if not k[0]]
    kind = F.when(number(0, 2) == 0, number(9, len(yes))).otherwise(len(yes) + number(9, len(no)))
    rows = rows.withColumn("kind", kind)

    def by_kind(of, default) -> Column:
        out = F.lit(default)
        for i, k in enumerate(yes + no):
            out = F.when(F.col("kind") == i, of(k)).otherwise(out)
        return out

    name = by_kind(lambda k: pick(k[2], 13) if k[2] else F.col("w2"), "")
    way = by_kind(lambda k: F.lit({True: "given", False: "alone", None: "url"}[k[3]]), "")
    name = F.when(number(16, 4) == 0, F.upper(name)).otherwise(name)
    rows = cut(rows.select("id", by_kind(lambda k: F.lit(float(k[0])), 0.0).alias("label"), by_kind(lambda k: F.col(k[1]), "").alias("finding"), name.alias("name"), way.alias("way"), "w1", "w2", "w3", "w4"))

    f, style, quote = F.col("finding"), number(20, 5), pick(['"', "'"], 46)
    q = F.concat(quote, f, quote)
    style = F.when(f.rlike("[,;()<>{}\\[\\]]") & style.isin(1, 3), style - 1).otherwise(style)
    given, alone = F.col("way") == "given", pick([f, f, F.concat(f, F.lit(",")), F.concat(F.lit("("), f, F.lit(")"))], 49)
    address = F.concat(pick(["postgres", "mysql", "https", "amqp", "redis"], 50), F.lit("://"), pick([F.col("w3"), F.lit("")], 51), F.lit(":"), f, F.lit("@"), "w4", F.lit(".example/db"))
    written = F.when(F.col("way") == "url", address).when(~given, alone).when(style == 0, F.concat("name", F.lit("="), q)).when(style == 1, F.concat("name", pick(["=", ":"], 47), f)).when(style == 3, f).otherwise(q)
    before = F.when(~given, F.col("name")).when(style == 2, pick(["=", ":=", ":"], 48)).when(style.isin(3, 4), F.concat("name", F.lit(":"))).otherwise(F.col("w3"))
    before2 = F.when(given & (style == 2), F.col("name")).otherwise(F.col("w1"))
    return rows.select("label", before2.alias("before2"), before.alias("before"), written.alias("word"), F.col("w4").alias("after"), "finding").filter(f.isNotNull())


def bounded(findings: DataFrame, most: int) -> DataFrame:
    """At most so many distinct findings of each label, the smallest by a hash."""
    context = ["before2", "before", "word", "after", "finding"]
    some = findings.select(F.col("label").cast("double").alias("label"), *context).distinct()
    first = [some.filter(F.col("label") == x).orderBy(F.xxhash64(*context), *context).limit(most) for x in (0.0, 1.0)]
    return cut(first[0].unionByName(first[1]).coalesce(1))


class Judge:
    """What is learned: the corpus's dictionary and transitions, words beside findings, and the forest."""

    def __init__(self, docs: DataFrame, findings: DataFrame | None = None, most: int = MOST_LABELLED):
        spark = docs.sparkSession
        self.known = dictionary(docs)
        self.logs = transitions(self.known)
        sample = bounded(planted(spark, self.known) if findings is None else findings, most)
        if findings is not None and sample.select("label").distinct().count() < 2:
            sample = cut(sample.unionByName(bounded(planted(spark, self.known), most)))
        sample = sample.withColumn("order", F.xxhash64("before2", "before", "word", "after", "finding", F.lit(1)))
        rows = cut(described(sample, self.known, self.logs))
        # Words beside are weighed on one half, the forest is fitted on the other, so that it doesn't trust them too much.
        half = F.pmod(F.col("order"), F.lit(2))
        self.odds = neighbours(rows.filter(half == 0))
        fitted = weighed(rows.filter(half == 1), self.odds).select("label", "order", *FEATURES).coalesce(1).sortWithinPartitions("order", *FEATURES)
        self.vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        self.forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(self.vector.transform(cut(fitted.drop("order"))))

    def judged(self, found: DataFrame) -> DataFrame:
        """found (finding and context) with FEATURES, score (the forest's probability of a secret) and is_secret."""
        rows = weighed(described(found, self.known, self.logs), self.odds)
        out = self.forest.transform(self.vector.transform(rows)).withColumn("score", vector_to_array("probability")[1])
        return out.drop("features", "rawPrediction", "probability", "prediction").withColumn("is_secret", F.col("score") >= 0.5)


def secrets(docs: DataFrame, findings: DataFrame | None = None, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, copy, word_index, finding, its context, FEATURES, score and is_secret of every candidate in docs.

    findings: labelled ones (label 0 or 1, before2, before, word, after,
    finding), by default planted ones, which also help out where given ones
    have one label alone.  Null and empty texts have no candidates; very long
    ones are scanned whole; repeated rows return theirs each time; a null id is
    kept as null; a score of just 0.5 is a secret; an empty table has no
    candidates; other columns are ignored.
    """
    return Judge(docs, findings, most).judged(cut(candidates(docs)))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each secret's characters replaced by a mask, and n_chars to match; other rows and columns as they are, whatever their names.

    Only texts with a candidate are shuffled, to meet their secrets; all others
    (null and empty ones among them) pass by.  Repeated rows are masked alike;
    an empty table stays empty.
    """
    found = cut(secrets(docs).filter("is_secret").groupBy("copy").agg(F.collect_set("finding").alias("found")))
    rows, held = docs.select(F.struct(*docs.columns).alias("row")), F.coalesce(F.col("row.text").rlike(HELD), F.lit(False))
    met = rows.filter(held).withColumn("copy", F.unhex(F.md5("row.text"))).join(found, "copy", "left")
    # Longer ones first: one secret may lie within another.
    order = F.array_sort("found", lambda a, b: F.length(b) - F.length(a))
    masked = F.aggregate(order, F.col("row.text"), lambda t, x: F.replace(t, x, F.lit(MASK)))
    met = met.withColumn("text", F.when(F.col("found").isNull(), F.col("row.text")).otherwise(masked))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("found").isNull(), F.col("row.n_chars")).otherwise(F.length("text")).cast("long")}
    met = met.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
    return rows.filter(~held).select(*[F.col("row")[c].cast("long").alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns]).unionAll(met)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "word_index", F.sha2("finding", 256).alias("finding_sha256"), *[F.round(c, 9).alias(c) for c in FEATURES], F.round("score", 6).alias("score"), "is_secret")
