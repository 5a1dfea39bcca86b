"""URL filters [native]: rules, then logistic regression on hashed character n-grams of host and path.

Everything on the main path is DataFrame and SQL functions; the regression is MLlib's, fitted on a small labelled
table whose bound is a parameter. Weights are one array of `bins` numbers, so they travel as a literal.

The labelled table is made by rule from two lists of subject words, chosen without the pages; `held_out_errors` tells what a
fit without a fifth of the words makes of the urls of those.

Defined results: a null url or one without `://` has empty host and path, fits no rule and gets the model's verdict
on empty strings; very long urls are cut into n-grams whole, in one row's memory; repeated rows are judged alike; columns of
other names are not read by the query; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table

BINS = 4096
GRAM_SIZES = (3, 4)
MAX_LABELLED = 200
REGULARISATION = 0.005

#: (rule, verdict): the host and its subdomains, where the path starts as the rule's. Fixed values of the query.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

#: Subjects of unwanted and of ordinary hosts.
UNWANTED = (
    "casino", "poker", "jackpot", "roulette", "slots", "bets", "betting", "gambling", "lottery", "pills", "pharmacy", "viagra", "adult", "porn",
    "xxx", "cams", "escort", "payday", "loans", "replica", "warez", "torrents", "keygen", "phishing", "malware", "spam", "adserver", "popups", "clickbait",
)
ORDINARY = (
    "library", "museum", "university", "school", "weather", "news", "recipes", "garden", "history", "science", "maps", "travel", "books", "music",
    "theatre", "cinema", "health", "hospital", "city", "station", "rivers", "mountains", "nature", "animals", "art", "architecture", "languages",
    "letters", "notes", "journal", "forum", "wiki", "software", "research", "physics", "chemistry", "kitchen", "football", "family", "weekend",
    "bridge", "ocean", "thunder", "morning", "answers", "nation", "another", "together", "thinking", "reading", "teaching", "whether", "tradition",
    "anderson", "erikson", "internet", "earth", "heather", "easton", "worthing",
)
#: Words that sell, beside an unwanted subject, and plain ones beside an ordinary one.
SELLING = ("free", "cheap", "best", "win", "hot", "fast", "bonus", "deals")
PLAIN = ("the", "my", "old", "blog", "daily", "notes", "guide", "house")
SHAPES = ("http://{}.example.com/en/41", "https://www.{}.example.org/fr/2290.html", "http://m.{}.example.net/de/7", "https://blog.{}.example.com/es/310/?page=2")


def labelled_urls(unwanted: tuple[str, ...] = UNWANTED, ordinary: tuple[str, ...] = ORDINARY) -> list[tuple[str, int]]:
    """(url, 1 for unwanted): each subject alone and beside a word of its kind, in shapes that both kinds share."""
    out = []
    for words, beside, label in ((unwanted, SELLING, 1), (ordinary, PLAIN, 0)):
        for k, word in enumerate(words):
            other = beside[k % len(beside)]
            names = (word, f"{other}-{word}" if k % 2 else f"{word}-{other}")
            out += [(SHAPES[(k + j) % len(SHAPES)].format(name), label) for j, name in enumerate(names)]
    return out


def with_host_path(df: DataFrame, url: str = "url", host: str = "host", path: str = "path") -> DataFrame:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without `://`."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    lower = F.translate(F.regexp_extract(text, whole, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumns({host: lower, path: F.regexp_extract(text, whole, 2)})


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; the rules are few and become one expression."""
    rule = verdict = F.lit(None).cast("string")
    for r, v in sorted(rules, key=lambda x: (len(x[0]), x[0])):
        h, p = r.split("/", 1)
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def gram_bins(host: Column, path: Column, bins: int = BINS) -> Column:
    """Bins (crc32 of the gram, modulo) of the character n-grams of `^host$` and of the path (any digit as 0), one entry an occurrence."""

    def of_size(text: Column, mark: str, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (n - 1)))
        return F.transform(starts, lambda i: F.pmod(F.crc32(F.concat(F.lit(mark), F.substring(text, i, F.lit(n))).cast("binary")), F.lit(bins)).cast("int"))

    def grams(text: Column, mark: str) -> list[Column]:
        return [of_size(text, mark, n) for n in GRAM_SIZES]

    return F.concat(*grams(F.concat(F.lit("^"), host, F.lit("$")), "h"), *grams(F.translate(path, "123456789", "000000000"), "p"))


def fit(labelled: DataFrame, bins: int = BINS, max_rows: int = MAX_LABELLED, regularisation: float = REGULARISATION) -> tuple[list[float], float]:
    """Weights and intercept from labelled (url, label int); more than max_rows rows are refused, as the fit runs in one task."""
    if (n := labelled.limit(max_rows + 1).count()) > max_rows:
        raise ValueError(f"more than {max_rows} labelled urls")
    if not n:
        return [0.0] * bins, 0.0
    f = with_host_path(labelled, "url", "_host", "_path").select("url", F.col("label").cast("double").alias("label"), gram_bins(F.col("_host"), F.col("_path"), bins).cast("array<string>").alias("_bins"))
    vectors = CountVectorizerModel.from_vocabulary([str(k) for k in range(bins)], "_bins", "features")
    rows = vectors.transform(f).select("url", "label", "features").coalesce(1).sortWithinPartitions("url", "label")
    model = LogisticRegression(maxIter=60, regParam=regularisation, standardization=False).fit(rows)
    return [float(x) for x in model.coefficients], float(model.intercept)


def held_out_errors(spark: SparkSession, every: int = 5, part: int = 2, regularisation: float = REGULARISATION) -> dict[str, tuple[int, int]]:
    """(errors, urls) of the fitted and of the held-out words, where every fifth word is held out; a report, no part of the query."""
    split = [(w[k::every], tuple(x for j, x in enumerate(w) if j % every != k)) for w, k in ((UNWANTED, part), (ORDINARY, part))]
    schema = "url string, label int"
    fitted = spark.createDataFrame(labelled_urls(split[0][1], split[1][1]), schema)
    model, out = fit(fitted, regularisation=regularisation), {}
    for name, rows in (("fitted", fitted), ("held out", spark.createDataFrame(labelled_urls(split[0][0], split[1][0]), schema))):
        wrong = (F.col("verdict") == "block") != (F.col("label") == 1)
        out[name] = tuple(judge(rows, model, []).agg(F.coalesce(F.sum(wrong.cast("int")), F.lit(0)), F.count(F.lit(1))).first())
    return out


def judge(df: DataFrame, model: tuple[list[float], float], rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """df with host, path, rule, verdict and probability (of being unwanted, by the model)."""
    weights, intercept = model
    out = with_host_path(df, url).withColumn("_bins", gram_bins(F.col("host"), F.col("path"), len(weights)))
    w = F.array(*map(F.lit, weights))
    total = F.aggregate("_bins", F.lit(0.0), lambda a, b: a + F.get(w, b))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(total + intercept)))
    return out.withColumns({"rule": rule, "probability": p}).withColumn("verdict", F.coalesce(verdict, F.when(F.col("probability") >= 0.5, "block").otherwise("allow"))).drop("_bins")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(f"('{url}', {label})" for url, label in labelled_urls())
    model = fit(spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, label)"))
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), model, RULES).select("page_id", "host", "path", "rule", "verdict", "probability")
