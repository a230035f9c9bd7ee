"""Rules on hosts and paths, and logistic regression on character n-grams for the URLs that no rule decides."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N_GRAMS = (3, 4)
BUCKETS = 1 << 12
REGULARISATION = 0.02

# Names of hosts that a general blocklist and a general directory would hold.
BLOCKED_NAMES = (
    "account-verify-now adclick adserver adult-chat adult-video ads-network banner-ads bestcasino betonline bets24 bingo-bonus bulk-mailer buy-followers casinoroyal cheap-meds "
    "cheap-replica clickbait-ads crack-keygen crypto-doubler diet-pills escorts free-iphone free-money free-spins freebies-now get-rich-quick hotgirls-xxx jackpot-slots "
    "linkfarm lottery-prize malware-download nude-pics online-casino payday-loans pharmacy-discount phishing-login pills-online poker-room popunder-ads porn-tube "
    "quick-cash replica-watches roulette seo-farm sex-cams slots-bonus spam-links spam-mailer spammers sports-betting torrent-movies tracker-pixel tracking-pixel usertrack "
    "viagra-store warez web-tracking weightloss-miracle win-prize winner-claim xxx-video you-win"
).split()
ALLOWED_NAMES = (
    "address-book adventure airport alphabet architecture author-talks bakery better-homes biology bookshop brother-stories chemistry city-council contracts cooking cycling dairy-farm "
    "earth-watch education engineer essex-county farmers-market football foundation freedom-press garden gathering-place gazette government grads headstart health-advice herald "
    "history hospital hotel information journal knitting lather-soap library loading-bay magazine mathematics mother-care museum music nation north-shore northern other-worlds painting "
    "photography physics pillow-shop python-guide racing-club railway reading-room restaurant roads school science software spelling stable-diffs station sussex table-tennis theatre "
    "therapy thinking thread-shop times together track-and-field tradesmen translation transport travel treadmill tribune truthful university weather weathering whether-report wiki windmill winter-sports workable writing"
).split()
_ZONES = ("com", "example.org", "net", "example.com", "org", "example.net", "info")
_PREFIXES = ("", "www.", "blog.", "m.")
_PATHS = ("/en/12", "", "/de/7.html", "/articles/2024/05/", "/fr/310/", "/questions/1", "/es/44", "/index.html", "/en/9031?page=2")


def general_table(copies: int = 3) -> list[tuple[str, int]]:
    """(url, label), 1 = block: every name in `copies` URLs; zones, prefixes and paths go round alike for both labels."""
    return [
        (f"https://{_PREFIXES[(i + k) % 4]}{name}.{_ZONES[(i + 2 * k) % 7]}{_PATHS[(i + 4 * k) % 9]}", label)
        for label, names in ((1, BLOCKED_NAMES), (0, ALLOWED_NAMES)) for i, name in enumerate(names) for k in range(copies)
    ]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.regexp_extract(after, r"(?s)^([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does; rules are (verdict, host, path).

    A rule fits its host and all hosts below it, if the path starts with the rule's. Of rules as long as each other the
    first by name wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, on, under in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(under)
        rule, verdict = F.when(fits, F.lit(on + under)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, marked by which of the two they are from; digits are one character."""

    def cut(mark: str, text: Column, n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.transform(at, lambda i: F.concat(F.lit(mark), text.substr(i, F.lit(n))))

    shown = {m: F.concat(F.lit("^"), F.regexp_replace(t, "[0-9]+", "0"), F.lit("$")) for m, t in (("h", host), ("p", path))}
    return reduce(F.concat, [cut(mark, text, n) for mark, text in shown.items() for n in N_GRAMS])


def _hashed(frame: DataFrame, host: Column, path: Column) -> DataFrame:
    hasher = HashingTF(binary=True, numFeatures=BUCKETS, inputCol="_grams", outputCol="_features")
    return hasher.transform(frame.withColumn("_grams", grams(host, path)))


def judged(
    pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) per row of `pages`.

    The host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; the path goes on to `?`,
    `#` or the end. A rule decides where one fits; else `block` if the classifier's probability is 0.5 or more.
    `labelled` (url, label) trains it, by default general_table(); it is small and its n-grams are hashed to BUCKETS numbers.
    A null or malformed URL has an empty host and path and is judged like any other. Rows are judged one by one.
    """
    spark = pages.sparkSession
    if labelled is None:
        labelled = spark.createDataFrame(general_table(), "url string, label int")
    host, path = parts(F.col("url"))
    train = _hashed(labelled.select(F.col("label").cast("double").alias("label"), host.alias("host"), path.alias("path")), F.col("host"), F.col("path"))
    model = LogisticRegression(featuresCol="_features", labelCol="label", regParam=REGULARISATION, standardization=False).fit(train.coalesce(1))
    model.setProbabilityCol("_probability").setRawPredictionCol("").setPredictionCol("")
    host, path = parts(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = model.transform(_hashed(split, F.col("host"), F.col("path")))
    score = vector_to_array("_probability")[1]
    return scored.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(score >= 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), score.alias("block_score"),
    )
