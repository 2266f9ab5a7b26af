"""URL filters: rules on host suffix and path prefix, and gradient-boosted trees for what no rule covers.

Everything here is DataFrame expressions and Spark's own boosted trees, so it runs in the JVM. The trees learn from
labelled URLs, those that a rule covers, on lexical features: length, depth, digit ratio, entropy, parameter counts and the
block rate of the host's suffix among the labelled.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.common import saved

#: (rule, verdict): a host and the beginning of a path.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "entropy", "parameters", "query_length", "fragment", "dashes", "suffix_rate", "suffix_seen")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if null or without ://."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def matching_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls; of equally long ones the first in order of strings."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, v in sorted(rules, key=lambda x: (len(x[0]), [-ord(c) for c in x[0]])):
        h, slash, p = r.partition("/")
        h = h.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits a character; 0 for empty texts."""
    n = F.char_length(text)
    share = lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: F.when(F.char_length(c) > 0, a - share(c) * F.log2(share(c))).otherwise(a))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    n = F.greatest(F.char_length(text), F.lit(1))
    left = lambda c, kept: F.char_length(F.regexp_replace(c, kept, ""))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    return {
        "length": F.char_length(text), "host_length": F.char_length(host), "path_length": F.char_length(path),
        "depth": left(path, "[^/]"), "labels": left(host, r"[^.]"), "digits": left(text, "[^0-9]") / n, "entropy": entropy(text),
        "parameters": F.when(F.char_length(query) > 0, left(query, "[^&]") + 1).otherwise(0), "query_length": F.char_length(query),
        "fragment": F.instr(text, "#") > 0, "dashes": left(text, "[^-_]"),
    }


def judge(pages: DataFrame, rules=RULES, most: int = 20_000, trees: int = 12, depth: int = 4) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url), and score where the trees decided.

    Classes and the counts and block rates of suffixes are of all labelled rows, but for the copies of a URL that is learnt from: its own
    label is no part of its features. The trees see at most `most` distinct labelled URLs, of
    either verdict those with the least hashes, weighted by their copies. Null and malformed URLs have empty host and path;
    no rule fits them, so the trees decide, as for any other. If all labelled URLs have one verdict, so have the rest; without
    labelled URLs the rest are allowed. Repeated rows are judged each, so ties need no order. URLs are read whole, however long;
    a table without rows gives none; other columns are ignored, whatever their names.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    host, path = host_of(F.col("url")), path_of(F.col("url"))
    read = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    read = read.withColumn("rule", rule).withColumn("ruled", verdict)
    features = {k: v.cast("double") for k, v in lexical(F.col("url"), F.col("host"), F.col("path")).items()}
    labels = read.where("ruled is not null").select("url", "host", "path", (F.col("ruled") == "block").cast("double").alias("label"), suffix_of(F.col("host")).alias("suffix"))
    # counts and rates are of all labelled rows; only the fit below sees a sample
    rates = saved(labels.groupBy("suffix").agg(F.sum("label").alias("blocked"), F.count("*").cast("double").alias("seen")), "suffixes")
    classes = rates.agg(F.sum("blocked") / F.sum("seen")).first()[0]
    out = ("page_id", "host", "path", "rule")
    if classes in (None, 0.0, 1.0):
        return read.select(*out, F.coalesce("ruled", F.lit("block" if classes else "allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))

    each = most // 2  # of either class, so that both are seen whatever their shares
    urls = labels.groupBy("url").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.first("label").alias("label"), F.count("*").cast("double").alias("copies"))
    urls = saved(urls, "labelled")
    sample = None
    for label in (0.0, 1.0):
        of = urls.where(F.col("label") == label)
        total = of.agg(F.sum("copies")).first()[0]
        took = saved(of.orderBy(F.xxhash64("url"), "url").limit(each), f"sample{int(label)}")
        # weights by copies, and of each class together as in all labelled rows
        held = took.agg(F.sum("copies")).first()[0]
        took = took.withColumn("weight", F.col("copies") * F.lit(total / held))
        sample = took if sample is None else sample.union(took)

    def with_features(df: DataFrame, own: Column | float = 0.0, own_blocked: Column | float = 0.0) -> DataFrame:
        """own: the rows with the same labelled URL, which say nothing about their own suffix."""
        df = df.join(rates, suffix_of(F.col("host")) == rates["suffix"], "left").drop(rates["suffix"])
        seen = F.coalesce("seen", F.lit(0.0)) - own
        rate = (F.coalesce("blocked", F.lit(0.0)) - own_blocked + 4 * F.lit(classes)) / (seen + 4)  # rare suffixes are near the mean of all
        known = {**features, "suffix_rate": rate, "suffix_seen": F.log1p(seen)}
        return df.withColumns({f"x_{k}": known[k] for k in FEATURES})

    assembler = VectorAssembler(inputCols=[f"x_{k}" for k in FEATURES], outputCol="x")
    model = GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, seed=7).fit(assembler.transform(with_features(sample, F.col("copies"), F.col("copies") * F.col("label"))))
    # only what no rule covers is scored
    ruled = read.where("ruled is not null").select(*out, F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("score"))
    rest = model.transform(assembler.transform(with_features(read.where("ruled is null")))).withColumn("score", vector_to_array("probability")[1])
    return ruled.union(rest.select(*out, F.when(F.col("score") > 0.5, "block").otherwise("allow").alias("verdict"), "score"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, longest rule and its verdict of every page, without the trees."""
    from strataline.llm.common import table

    parts = table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), RULES)
    return parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))


def _rules_sql() -> str:
    rows = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in RULES)
    return f"""WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rule, h, p, verdict) AS (VALUES {rows}), m AS (SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, rule) AS k FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p))
SELECT p.page_id, host, path, rule, verdict AS ruled FROM p LEFT JOIN m ON m.page_id = p.page_id AND k = 1"""


RULES_SQL = _rules_sql()


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataline.llm.common import table

    return judge(table(spark, sf_dir, "pages"))
