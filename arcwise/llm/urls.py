"""URL filters: rules, and logistic regression on hashed character n-grams."""

from __future__ import annotations

import random

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwise.llm.tables import read

#: Hash buckets, n-gram sizes, the most labelled rows that training takes, and the weight of the squared weights.
BUCKETS, SIZES, LABELLED, PENALTY = 1 << 13, (3, 4, 5), 10_000, 3e-6

#: General words of the trades that filter lists block, and of everyday sites; a site's name is made of two of a kind.
BLOCKED_WORDS = (
    "casino poker slots roulette jackpot betting bets wager lotto bingo pills viagra cialis meds steroids porn xxx sex adult cams escort nude "
    "erotic ads adserver banner popup tracker click affiliate spam phish scam backlinks clickbait giveaway prize payday loans replica cheap free "
    "crack keygen warez torrent hack"
).split()
ALLOWED_WORDS = (
    "library garden museum weather history school travel recipe kitchen science music theatre letters mountain river market village football "
    "cycling journal photo archive atlas bakery bridge castle chess church city climate college concert craft culture dance design diary doctor "
    "education energy family farm fashion film forest gallery geology harbour health hiking hospital hotel house island jazz knitting language law "
    "maths medicine memory nature news north novel ocean orchard paint paper physics piano planet poetry politics pottery project radio railway "
    "report research sailing season shop society software space sport stone story student summer teacher tennis theory tools town union "
    "university valley video water wild winter wood work world writing yoga"
).split()
#: Never trained on: words of both kinds for the figures of the README.
KEPT_OUT_BLOCKED = "blackjack sportsbook pharmacy cialisonline xxxvideos sexcam adclick popunder loanshark phishing".split()
KEPT_OUT_ALLOWED = "lighthouse carpentry astronomy vineyard violin choir bookshop meadow gazette botany".split()
#: Parts that invented names are made of, by rule: clean hosts are mostly names that no word list has.
ONSETS, VOWELS, ENDS = "b bl br c ch cl d dr f fl g gr h j k l m n p pl pr qu r s sh sl st t th tr v w wh z".split(), "a e i o u ai ea ee io ou".split(), "n r l s t m d nd ng nt rd st sh th ck x".split()
PREFIXES, DOMAINS, LANGS = ("", "www.", "blog.", "m.", "news.", "img2."), ("com", "net", "org", "info", "example.com", "example.org", "co.uk"), ("en", "de", "fr", "es", "it")

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def site_names(words: list[str], step: int) -> list[str]:
    """Each word with the one ``step`` places on, joined in turn by nothing, a hyphen and a number."""
    return [f"{w}{('', '-', str(i))[i % 3]}{words[(i + step) % len(words)]}" for i, w in enumerate(words)]


def invented_names(n: int, seed: int) -> list[str]:
    """Names of one to four made-up syllables, some without a vowel, some with a hyphen or a number."""
    r, out = random.Random(seed), []
    for _ in range(n):
        parts = []
        for _ in range(r.choice((1, 2, 2, 3, 4))):
            parts.append(r.choice((r.choice(ONSETS) + r.choice(VOWELS), r.choice(VOWELS) + r.choice(ENDS), r.choice(ONSETS) + r.choice(VOWELS) + r.choice(ENDS), r.choice(ONSETS) + r.choice(ENDS))))
        out.append(r.choice(("", "", "", "-")).join(parts) + r.choice(("", "", "", "", str(r.randrange(2000)), "-" + r.choice("xyz"))))
    return out


def any_path(r: random.Random, word: str) -> str:
    """A path of one of many shapes, with ``word`` in some."""
    n = r.randrange(10_000)
    day = f"{r.randrange(1998, 2024)}/{r.randrange(1, 13):02}"
    shapes = ("", "/", "/about", f"/{r.choice(LANGS)}/{n}", f"/{r.choice(LANGS)}/{n}.html", f"/{r.choice(LANGS)}/{n}/", f"/{day}/post.html", f"/index.php/{n}", f"/{word}", f"/tag/{word}/page/{n % 9}", f"/a/{word}/{'-'.join(invented_names(3, n))}/{n}")
    return r.choice(shapes)


def labelled_urls(spark: SparkSession, seed: int = 5, without: tuple[str, ...] = ()) -> DataFrame:
    """``url, label`` (1: block): blocked words in names and paths, beside clean names of many shapes.

    Half are clean: invented names (most), everyday words, pairs of them and plain numbers. Blocked words come alone, in pairs, and with clean or
    invented names before or behind them; on both sides hosts, endings and paths are drawn alike. Words in ``without`` are left out.
    """
    r, rows = random.Random(seed), []
    blocked, allowed = ([w for w in words if w not in without] for words in (BLOCKED_WORDS, ALLOWED_WORDS))
    clean = invented_names(7000, seed) + allowed + site_names(allowed, 11) + site_names(allowed, 29) + [str(r.randrange(10**6)) for _ in range(40)]
    names = [(name, 0, r.choice(clean)) for name in clean]
    for word in blocked:
        for k in range(40):
            other, glue = r.choice(clean), r.choice(("", "", "-", str(k % 10)))
            name = (word, f"{word}{glue}{other}", f"{other}{glue}{word}", f"{word}{glue}{r.choice(blocked)}", f"{word}-{r.choice('xyz')}")[k % 5]
            names.append((name, 1, r.choice(clean)))
    for name, label, word in names:
        rows.append((f"{r.choice(('http', 'https'))}://{r.choice(PREFIXES)}{name}.{r.choice(DOMAINS)}{any_path(r, word)}", label))
    for word in blocked:
        rows += [(f"https://{r.choice(PREFIXES)}{r.choice(clean)}.{r.choice(DOMAINS)}/{word}/{k}", 1) for k in range(6)]
    return spark.createDataFrame(rows, "url string, label int")


def host_and_path(url: str) -> tuple[F.Column, F.Column]:
    """After the first ``://``: the host with A-Z lower-cased, and the path before any query or fragment."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def _bucket(marked: F.Column, part: str, n: int):
    return lambda i: F.pmod(F.xxhash64(F.lit(part.strip("_")), F.substring(marked, i, F.lit(n))), F.lit(BUCKETS)).cast("int")


def grams(host: str, path: str) -> F.Column:
    """Bucket numbers of all n-grams of host and path, with marks at both ends."""
    lists = []
    for part in (host, path):
        marked = F.concat(F.lit("\x02"), F.col(part), F.lit("\x03"))
        for n in SIZES:
            spots = F.sequence(F.lit(1), F.length(marked) - (n - 1))
            lists.append(F.when(F.length(marked) >= n, F.transform(spots, _bucket(marked, part, n))).otherwise(F.array().cast("array<int>")))
    return F.concat(*lists)


def train_url_model(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights of the buckets and a constant, from ``url, label``.

    At most ``LABELLED`` rows count, the first by hash; null urls and labels other than 0
    and 1 are left aside. A feature is a bucket's share of the url's n-grams. With labels of one kind only
    the constant alone decides.
    """
    host, path = host_and_path("url")
    rows = labelled.where(F.col("url").isNotNull() & F.col("label").isin(0, 1)).orderBy(F.xxhash64("url", "label"), "url").limit(LABELLED)
    rows = rows.select(host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label"))
    rows = rows.select("label", F.transform(grams("host", "path"), lambda b: b.cast("string")).alias("g"))
    if rows.isEmpty():
        return [0.0] * BUCKETS, -1.0
    counts = CountVectorizerModel.from_vocabulary([str(b) for b in range(BUCKETS)], "g", "counts")
    rows = Normalizer(p=1.0, inputCol="counts", outputCol="features").transform(counts.transform(rows)).select("label", "features").coalesce(1)
    model = LogisticRegression(regParam=PENALTY, maxIter=200, standardization=False, family="binomial").fit(rows)
    return [float(w) for w in model.coefficients.toArray()], float(model.intercept)


def matching_rule(rules, host: str, path: str, value) -> F.Column:
    """``value(verdict, rule)`` of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        inside = (F.col(host) == name) | F.col(host).endswith(f".{name}")
        found = F.when(inside & F.col(path).startswith(slash + rest), F.lit(value(verdict, rule))).otherwise(found)
    return found


def judge_urls(pages: DataFrame, rules, model: tuple[list[float], float], url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` and the method's ``score``.

    A rule fits its host and that host's subdomains where the path starts with
    the rule's; the longest wins. Elsewhere the model blocks from a score of 0.5.
    Null urls and those without ``://`` have an empty host and path, fit no rule
    and are scored as such. Rows may repeat; columns of the new names are
    replaced, others kept; an empty table gives an empty result.
    """
    weights, constant = model
    new = ("host", "path", "rule", "verdict", "score")
    host, path = host_and_path(url)
    # own columns travel in one, so that no working name can clash with theirs
    rows = pages.select(F.struct(*pages.columns).alias("row"), host.alias("host"), path.alias("path"))
    # a constant of BUCKETS numbers
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    rows = rows.withColumn("g", grams("host", "path"))
    total = F.aggregate("g", F.lit(0.0), lambda s, g: s + F.element_at(table, g + 1))
    score = 1 / (1 + F.exp(-(total / F.greatest(F.size("g"), F.lit(1)) + constant)))
    rule = matching_rule(rules, "host", "path", lambda verdict, rule: rule)
    ruled = matching_rule(rules, "host", "path", lambda verdict, rule: verdict)
    rows = rows.select("row", "host", "path", rule.alias("rule"), ruled.alias("ruled"), score.alias("score"))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    kept = [F.col("row")[c].alias(c) for c in pages.columns if c not in new]
    return rows.select(*kept, "host", "path", "rule", verdict.alias("verdict"), "score")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages under the rules, else under the trained model."""
    model = train_url_model(labelled_urls(spark))
    judged = judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), RULES, model)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))
