"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

All of it is DataFrame operations and the JVM's tree learner. Labelled URLs train the trees: by default
those that a rule decides. Features: lengths, depth, digit ratio, entropy of the characters, numbers of
parameters, and how often the labelled hosts with the same last label are allowed (smoothed). That rate
leaves out a labelled url's own fold, so that a tree never sees a label in its own feature.

Suffixes are counted by partial sums, so a frequent one is a row a task. Their table is broadcast if it has at
most ``SMALL_SUFFIXES`` rows; else the urls are dealt by suffix and a salt, and the table is repeated for each salt.
The lexical features are written once, and all passes read them.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule, and is
judged by the trees like any other. Without labelled urls of both verdicts there is nothing to learn:
all others get the one verdict seen, or ``allow`` where none is seen. Repeated rows are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host/path`` for a host with its subdomains and urls whose path starts with the rule's."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
)
TRAIN_ROWS = 20_000
FOLDS = 5
#: Rows of the suffix table that are broadcast (a few hundred bytes each), and salts beyond.
SMALL_SUFFIXES = 100_000
SALTS = 64
FEATURES = ["url_len", "host_len", "path_len", "depth", "labels", "digit_ratio", "entropy", "params", "fragment", "dashes", "secure", "query_len", "suffix_rate", "suffix_seen"]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...], what: str) -> Column:
    """The longest rule that fits, else null. The rules stand in the plan: they are a short list."""
    if len(rules) > 1000:
        raise ValueError("more than 1000 rules: join them as a table")
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, what))) if out is None else out.when(fits, F.lit(getattr(r, what)))
    return out if out is not None else F.lit(None).cast("string")


def entropy(text: Column) -> Column:
    """Bits a character: one pass over the sorted characters sums c log c over runs of c equal ones."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("n"))
    closed = lambda a: a["sum"] + F.when(a["run"] > 1, a["run"] * F.log2(a["run"])).otherwise(0.0)

    def step(a: Column, c: Column) -> Column:
        same = a["last"] == c
        return F.struct(c.alias("last"), F.when(same, a["run"] + 1).otherwise(F.lit(1.0)).alias("run"), F.when(same, a["sum"]).otherwise(closed(a)).alias("sum"), (a["n"] + 1).alias("n"))

    return F.aggregate(chars, start, step, lambda a: F.when(a["n"] > 0, F.log2(a["n"]) - closed(a) / a["n"]).otherwise(0.0))


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features that need only ``url, host, path``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    count = lambda text, what: (F.length(text) - F.length(F.replace(text, F.lit(what)))).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    n = F.length(url)
    return df.withColumns(
        {
            "url_len": n.cast("double"),
            "host_len": F.length("host").cast("double"),
            "path_len": F.length("path").cast("double"),
            "depth": count(F.col("path"), "/"),
            "labels": count(F.col("host"), "."),
            "digit_ratio": F.when(n > 0, (n - F.length(F.translate(url, "0123456789", ""))) / n).otherwise(0.0),
            "entropy": entropy(url),
            "params": F.when(F.length(query) > 0, count(query, "&") + 1).otherwise(0.0),
            "fragment": F.contains(url, F.lit("#")).cast("double"),
            "dashes": count(F.col("host"), "-"),
            "secure": F.startswith(url, F.lit("https:")).cast("double"),
            "query_len": F.length(query).cast("double"),
            "suffix": F.substring_index("host", ".", -1),
        }
    )


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", label_col: str | None = None, rules: tuple[Rule, ...] = RULES, train_rows: int = TRAIN_ROWS, trees: int = 20, depth: int = 4, seed: int = 7) -> DataFrame:
    """``page_id, host, path, rule, verdict, score``; score is the trees' probability of allow.

    ``label_col`` may name a column with 1 for allow and 0 for block; else the rules label what they fit.
    The trees are fitted on at most ``train_rows`` labelled urls, those with the smallest hashes.
    """
    url = F.col(url_col).cast("string")
    x = df.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), *([F.col(label_col).cast("double").alias("label")] if label_col else []))
    x = x.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    host, path = F.col("host"), F.col("path")
    x = x.withColumns({"rule": rule_of(host, path, rules, "text"), "by_rule": rule_of(host, path, rules, "verdict")})
    if not label_col:
        x = x.withColumn("label", F.when(F.col("by_rule") == "allow", 1.0).when(F.col("by_rule") == "block", 0.0))
    x = lexical(x)
    x = cut_lineage(x.withColumns({"_order": F.xxhash64("url", F.lit(seed)), "_fold": F.pmod(F.xxhash64("url", F.lit(seed + 1)), F.lit(FOLDS)).cast("int")}))
    labelled = x.where("label is not null")
    seen = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect() if r["label"] in (0.0, 1.0)}
    if len(seen) < 2:
        only = next(iter(seen), 1.0)
        return x.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.lit("allow" if only else "block")).alias("verdict"), F.lit(only).alias("score"))
    prior = seen[1.0] / (seen[0.0] + seen[1.0])
    # allowed and all labelled urls of each suffix, over all folds and without each one
    of_fold = [f(F.when(F.col("_fold") == k, c)).alias(f"{n}{k}") for k in range(FOLDS) for n, f, c in (("a", F.sum, F.col("label")), ("s", F.count, F.lit(1)))]
    suffixes = cut_lineage(labelled.groupBy(F.col("suffix").alias("_suffix")).agg(F.sum("label").alias("_allowed"), F.count("*").alias("_seen"), *of_fold))
    small = suffixes.count() <= SMALL_SUFFIXES

    def with_suffix(rows: DataFrame) -> DataFrame:
        own = lambda n: F.coalesce(*[F.when((F.col("_fold") == k) & F.col("label").isNotNull(), F.coalesce(f"{n}{k}", F.lit(0))) for k in range(FOLDS)], F.lit(0))
        allowed, n = F.coalesce("_allowed", F.lit(0.0)) - own("a"), F.coalesce("_seen", F.lit(0)) - own("s")
        if small:
            rows = rows.join(F.broadcast(suffixes), F.col("suffix") == F.col("_suffix"), "left")
        else:
            salted = suffixes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            rows = rows.withColumn("_own_salt", F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS)).cast("int"))
            rows = rows.join(salted.hint("merge"), (F.col("suffix") == F.col("_suffix")) & (F.col("_own_salt") == F.col("_salt")), "left")
        return rows.withColumns({"suffix_rate": (allowed + 10 * prior) / (n + 10), "suffix_seen": F.log1p(n.cast("double"))})

    sample = labelled.orderBy("_order", "page_id").limit(train_rows)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    train = vectors.transform(with_suffix(sample)).orderBy("_order", "page_id").select("features", "label").coalesce(1)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.2, seed=seed).fit(train)
    out = model.transform(vectors.transform(with_suffix(x))).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce("by_rule", F.when(F.col("score") >= 0.5, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
