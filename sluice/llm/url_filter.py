"""URL filtering: rules by host and path, and for the rest a logistic regression on hashed character n-grams.

DataFrame functions only. The labelled table is small by contract (MAX_LABELLED rows), so the model is fitted in its
dual form, one coefficient per labelled URL, by one aggregate expression over the matrix of shared n-grams; the
weights by bucket follow from it. Scoring is a sum over a constant array, with no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The rules (verdict, rule) that the registered query applies.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: The small labelled table that the registered query learns from: names of hosts, written for it by hand from common
#: knowledge of what is blocked and what is not. No host or name of the table ``pages`` is among them.
BLOCKED_NAMES = """
royal-casino casino-jackpots onlinecasino slots-bonus pokerstake roulette-spins betting-tips sportsbets bet-365-now
lottery-winner win-a-prize big-wins-daily free-spins free-iphones free-gift-cards freebies-4u cheap-meds cheap-viagra
cheapwatches pills-online diet-pills pharma-pills replica-bags discount-rx miracle-cure loseweightfast hair-regrowth
adult-videos adult-dating adultcams xxx-tube xxx-movies porn-hd hot-singles sexcams escort-girls webcam-babes nude-pics
payday-loans fast-cash easy-money getrichquick forex-signals crypto-doubler work-from-home loan-shark spam-mailer
seo-spam spambot bulk-spam link-farm contentfarm article-farm buy-backlinks clickbait click-tracker ads-server adserving
popup-ads ad-tracking track-pixel banner-ads warez-crack keygen-serials torrent-cracks malware-drop phish-login
verify-account ringtones
""".split()
ALLOWED_NAMES = """
library museum weather gardening recipes cityhall university science history archive newspaper dictionary thesaurus
theatre theology thermodynamics theorems therapy-notes thenation thewinter-olympics nationalpark station-times
educational foundation translations traditions motorists authors fashion-history relations tourism chess-club
astronomy botany painting orchestra football rowing hospital nursing school-board college kindergarten parliament
ministry harbour railways airport bicycles hiking birdwatching forest river-trust ocean-data geology physics chemistry
biology medicine-journal mathematics statistics open-source python-docs linux-wiki compilers encyclopedia poetry
novels short-stories translators philosophy archaeology anthropology language-course grammar cooking bakery vineyard
farmers-market dairy-farm windmill adults-learning father-daughter additional shadows trackandfield teachers
gazette chronicle observer bulletin tribune letters weekly-review public-radio photography carpentry knitting
pottery genealogy council volunteers rescue shelter thistle northern southern eastern
""".split()
#: One and the same shapes of URLs for both, so that only the names tell.
SHAPES = (
    "http://www.{}.example.com/en/12",
    "https://{}.example.org/en/728?utm_source=feed",
    "https://blog.{}.example.net/fr/1930#top",
    "http://m.{}.example.org/de/6/",
    "https://{}.example.com/es/4402.html",
    "http://{}.org/2019/05/first-page",
    "https://www.{}.net/index.php?page=2&ref=x",
    "http://{}.example.net/en/5377#top",
    "https://m.{}.example.com/fr/88.html",
    "http://{}.com/",
    "https://blog.{}.example.org/en/3311/",
)

BUCKETS = 4096
SIZES = (3, 4)
MAX_LABELLED = 500
MAX_RULES = 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or where there is no ``://``."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(text, shape, 1), upper, upper.lower()), F.regexp_extract(text, shape, 2)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, or null. Of rules as long, the first by text."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def features(host: Column, path: Column) -> Column:
    """Distinct buckets of the character n-grams of host and path, each marked with where it stands.

    A text is cut into its characters once and n-grams are put together from those, as finding each by its place would
    take a time with the square of a long path's length. The arrays of one element bind what is made once.
    """

    def grams(kind: str, n: int, chars: Column) -> Column:
        def bucket(i: Column) -> Column:
            gram = F.concat(*[F.get(chars, i + k) for k in range(n)])
            return F.pmod(F.xxhash64(F.lit(kind), gram), F.lit(BUCKETS)).cast("int")

        starts = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, bucket)

    found = []
    for kind, text in (("h", host), ("p", path)):
        chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
        found.append(F.flatten(F.transform(F.array(chars), lambda c, kind=kind: F.concat(*[grams(kind, n, c) for n in SIZES]))))
    return F.array_distinct(F.concat(*found))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, blocked): every name in the next of the shapes."""
    rows = [
        (SHAPES[i % len(SHAPES)].format(name), blocked)
        for names, blocked in ((BLOCKED_NAMES, 1.0), (ALLOWED_NAMES, 0.0))
        for i, name in enumerate(names)
    ]
    return spark.createDataFrame(rows, "url string, blocked double")


def fit(labelled: DataFrame, rounds: int = 300, decay: float = 0.002) -> tuple[list[float], float]:
    """Weights by bucket and the bias, from (url, blocked 0.0 or 1.0); rows with a null are passed over.

    Features are binary and scaled to unit length. Gradient descent on mean log loss with decay runs in the dual form.
    Without labelled rows all weights are 0.
    """
    host, path = host_and_path(F.col("url"))
    known = labelled.select("url", "blocked").dropna().limit(MAX_LABELLED + 1)
    rows = known.select("url", F.col("blocked").cast("double").alias("y"), features(host, path).alias("f"))
    numbered = rows.select(F.row_number().over(Window.orderBy("url", "y")).alias("no"), "y", "f")
    one = numbered.agg(F.sort_array(F.collect_list(F.struct("no", "y", "f"))).alias("x"))
    gram = F.transform(
        "x",
        lambda a: F.transform(
            "x",
            lambda b: F.size(F.array_intersect(a["f"], b["f"]))
            / F.greatest(F.lit(1.0), F.sqrt(F.size(a["f"]).cast("double") * F.size(b["f"])))
            + 1.0,
        ),
    )
    size = F.size("x")

    def trained(shared: Column) -> Column:
        def step(alpha: Column, _: Column) -> Column:
            def moved(a: Column, i: Column) -> Column:
                z = F.aggregate(F.zip_with(F.get(shared, i), alpha, lambda g, v: g * v), F.lit(0.0), lambda s, v: s + v)
                return a * (1 - decay) - (1 / (1 + F.exp(-z)) - F.get("x", i)["y"]) * 8.0 / size

            return F.transform(alpha, moved)

        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array_repeat(F.lit(0.0), size), step)

    # the one-element array binds the matrix, which would else be made anew wherever it is read
    fitted = one.select("x", F.get(F.transform(F.array(gram), trained), F.lit(0)).alias("alpha"))
    model = fitted.where(F.size("x") > 0).select(F.explode(F.arrays_zip("x", "alpha")).alias("e")).select("e.x", "e.alpha")
    found = model.collect()
    if len(found) > MAX_LABELLED:
        raise ValueError(f"at most {MAX_LABELLED} labelled URLs")
    weights, bias = [0.0] * BUCKETS, 0.0
    for r in found:
        bias += r["alpha"]
        for bucket in r["x"]["f"]:
            weights[bucket] += r["alpha"] / max(1.0, len(r["x"]["f"]) ** 0.5)
    return weights, bias


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None, threshold: float = 0.5
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, block_probability.

    The longest rule that fits a URL's host (or a domain above it) and the start of its path decides; without one the
    model does: block from ``threshold`` on. A URL that is null or has no ``://`` has an empty host and path, no rule,
    and the model's verdict on no features. Repeated rows each get a row; an empty table gives an empty result. Extra
    columns are ignored.
    """
    weights, bias = fit(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    table = F.split(F.lit(" ".join(map(repr, weights))), " ").cast("array<double>")
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    found = rows.withColumn("m", matching_rule(F.col("host"), F.col("path"), rules)).withColumn(
        "f", F.when((F.col("host") == "") & (F.col("path") == ""), F.array().cast("array<int>")).otherwise(features(F.col("host"), F.col("path")))
    )
    total = F.aggregate("f", F.lit(0.0), lambda s, b: s + F.get(table, b))
    z = F.lit(bias) + total / F.greatest(F.lit(1.0), F.sqrt(F.size("f").cast("double")))
    scored = found.withColumn("block_probability", 1 / (1 + F.exp(-z)))
    by_model = F.when(F.col("block_probability") >= threshold, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.verdict", by_model).alias("verdict"), "block_probability"
    )
