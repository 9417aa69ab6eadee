"""URL filter by mined association rules, with given host and path rules on top.

Labelled urls become sets of tokens (host suffixes, host words, path words, file
type, query keys, scheme). Spark's FP-growth mines the token combinations that
come with a bad label; only rules of enough confidence and support stay, of any
number of tokens, less those that a shorter rule makes needless. Urls are matched by an inverted index: each distinct
url's tokens are joined with the rules' tokens, and a rule fits a url that has
as many of the rule's tokens as the rule. Everything runs on DataFrames.

Cases: a null url or one without "://" has an empty host and path and no tokens,
and no rule fits it; repeated urls are judged once and all get the verdict; with
no labelled urls, or none bad, no rule is mined and the verdict is allow; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CONFIDENCE = 0.8
#: A rule's tokens and a bad label come together in this share of labelled urls, and in this many.
MIN_SUPPORT, MIN_ROWS = 0.002, 10
#: Tokens of a rule in ``mine`` alone, as SQL counts them; ``judge_urls`` takes rules of any size.
MAX_TOKENS = 2
BAD = "label=bad"


@dataclass(frozen=True)
class HostRule:
    """``verdict`` for a host and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Host after the first "://", A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Path after the host, up to a query or fragment."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a url; digits in path words count as one sign."""
    host, path, rest = host_of(url), path_of(url), _rest(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    words = F.transform(F.regexp_extract_all(host, F.lit(r"([^.\-]+)"), 1), lambda w: F.concat(F.lit("word="), w))
    steps = F.transform(F.regexp_extract_all(path, F.lit(r"/([^/]+)"), 1), lambda s: F.concat(F.lit("path="), F.regexp_replace(s, "[0-9]+", "0")))
    kind = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.regexp_extract_all(query, F.lit("(?:^|&)([^=&]+)"), 1), lambda k: F.concat(F.lit("key="), k))
    scheme = F.translate(F.regexp_extract(url, "^([A-Za-z]+)://", 1), UPPER, LOWER)
    one = F.filter(F.array(F.when(kind != "", F.concat(F.lit("type="), kind)), F.when(scheme != "", F.concat(F.lit("scheme="), scheme))), lambda t: t.isNotNull())
    return F.when(host != "", F.array_distinct(F.concat(suffixes, words, steps, keys, one))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS,
         max_tokens: int | None = MAX_TOKENS) -> DataFrame:
    """Rules (rule_id, tokens, confidence, support) from ``labelled`` (url, bad boolean); of any size if ``max_tokens`` is None.

    A single token that is a rule makes rules that contain it needless; they stay, as they change no verdict.
    """
    baskets = written(labelled.select(F.array_union(tokens_of(F.col("url")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items")), "baskets")
    n = baskets.count()
    empty = baskets.select(F.lit(0).cast("long").alias("rule_id"), F.col("items").alias("tokens"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support")).limit(0)
    if not n:
        return empty
    parts = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_rows / n)), minConfidence=min_confidence, numPartitions=parts).fit(baskets)
    rules = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD)))
    if max_tokens is not None:
        rules = rules.filter(F.size("antecedent") <= max_tokens)
    tokens = F.array_sort("antecedent")
    return written(rules.select(F.xxhash64(tokens).alias("rule_id"), tokens.alias("tokens"), "confidence", "support"), "url-rules") if n >= min_rows else empty


def needed(rules: DataFrame) -> DataFrame:
    """``rules`` without those that hold a rule of one token less and no less confidence.

    That rule stays or holds such a rule itself, so each url keeps its verdict and best confidence.
    """
    less = rules.select("rule_id", "confidence", "tokens", F.explode("tokens").alias("token")).select("rule_id", "confidence", F.array_except("tokens", F.array("token")).alias("less"))
    shorter = rules.select(F.col("tokens").alias("less"), F.col("confidence").alias("own"))
    return rules.join(less.join(shorter, "less").filter("own >= confidence").select("rule_id").distinct(), "rule_id", "left_anti")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``url`` of ``urls`` that some rule fits, with its best confidence."""
    index = rules.select("rule_id", "confidence", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    tokens = urls.select("url").distinct().select("url", F.explode(tokens_of(F.col("url"))).alias("token"))
    hits = tokens.join(index, "token").groupBy("url", "rule_id", "size", "confidence").agg(F.count("*").alias("n")).filter("n = size")
    return hits.groupBy("url").agg(F.max("confidence").alias("confidence"))


def given_rule(host: Column, path: Column, rules: tuple[HostRule, ...]) -> Column:
    """(length, rule, verdict) of the longest of the caller's ``rules`` that fits; null if none does."""
    found = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
                    F.struct(F.lit(len(r.text)).alias("length"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in rules]
    if not found:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    return F.array_max(F.filter(F.array(*found), lambda x: x.isNotNull()))


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: tuple[HostRule, ...] = (), id_col: str = "page_id", url_col: str = "url",
               min_confidence: float = MIN_CONFIDENCE, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, max_tokens: int | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (the given rule's, else block if a mined rule fits)."""
    page = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    blocked = matched(page, needed(mine(labelled, min_confidence, min_support, min_rows, max_tokens))).select("url", "confidence")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = page.join(blocked, "url", "left").withColumn("host", host).withColumn("path", path).withColumn("given", given_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("given.verdict"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("given.rule").alias("rule"), verdict.alias("verdict"), "confidence")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of pages that show a labelled document: the first all-digit step of the path is its doc_id.

    A document of low quality or a toxic one is bad; null labels count as good.
    """
    doc = F.regexp_extract(path_of(F.col("url")), "/([0-9]{1,18})(?:[/.]|$)", 1).try_cast("long")
    bad = F.coalesce(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)), F.lit(False))
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(bad.alias("bad"))
    return pages.select(F.col("url").cast("string").alias("url")).withColumn("doc_id", doc).join(known, "doc_id").select("url", "bad")
