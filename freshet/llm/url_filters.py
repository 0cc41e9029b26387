"""URL filters: pattern rules fetched by their rarest literal token, on DataFrame functions alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.shared import table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The index goes into the plan as one literal; longer lists of rules are refused rather than planned badly.
MAX_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    """A regular expression over host + path, and the literal tokens that any match holds as whole tokens."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    base: bool = False


def prefix_rule(name: str, verdict: str) -> Rule:
    """``host/path`` as a rule: the host and its subdomains, paths that start with the rule's."""
    host, _, path = name.partition("/")
    quote = lambda s: "".join(c if c.isalnum() or c == "/" else f"[{c}]" for c in s)
    whole = [t for t in host.split(".") if t] + path.split("/")[:-1]
    return Rule(name, verdict, f"^([^/]*[.])?{quote(host)}/{quote(path)}", tuple(t for t in whole if t.isalnum() and t.isascii()), True)


def host_words(name: str, *words: str) -> Rule:
    """Blocks hosts that hold the words one after another, set off by dots, hyphens or the host's ends."""
    return Rule(name, "block", f"^([^/]*[.-])?{'-?'.join(words) if len(words) == 1 else '[.-]'.join(words)}([.-][^/]*)?(/|$)", words)


def path_word(name: str, word: str) -> Rule:
    """Blocks paths with a segment of that name."""
    return Rule(name, "block", f"^[^/]*/([^/]*/)*{word}(/|$)", (word,))


# The rules of the query's contract, and the method's own.
BASE_RULES = (
    prefix_rule("org/", "allow"),
    prefix_rule("example.org/es/", "block"),
    prefix_rule("example.org/en/1", "block"),
    prefix_rule("com/fr/", "allow"),
    prefix_rule("com/de/", "block"),
)
METHOD_RULES = (
    host_words("gambling-casino", "casino"),
    host_words("gambling-casino-win", "casino", "win"),
    host_words("gambling-bets", "bets"),
    host_words("gambling-poker", "poker"),
    host_words("gambling-slots", "slots"),
    host_words("drugs-pills", "pills"),
    host_words("drugs-cheap-pills", "cheap", "pills"),
    host_words("drugs-viagra", "viagra"),
    host_words("adult-porn", "porn"),
    host_words("adult-xxx", "xxx"),
    host_words("adult-sex", "sex"),
    host_words("piracy-torrent", "torrent"),
    host_words("piracy-warez", "warez"),
    host_words("finance-payday-loans", "payday", "loans"),
    host_words("goods-replica-watches", "replica", "watches"),
    path_word("utility-login", "login"),
    path_word("utility-cart", "cart"),
    path_word("utility-checkout", "checkout"),
)


def _host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _tokens(host: str, path: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.concat(host, path), "[^A-Za-z0-9]+"), lambda t: t != ""))


def token_counts(urls: DataFrame, wanted: list[str]) -> dict[str, int]:
    """In how many urls each wanted token stands; wanted is bounded by the rules, so the answer is."""
    held = urls.select(F.explode(F.array_intersect("_tokens", F.array(*[F.lit(w) for w in wanted]))).alias("t"))
    return dict.fromkeys(wanted, 0) | {r.t: r.n for r in held.groupBy("t").agg(F.count("*").alias("n")).collect()}


def url_filter(urls: DataFrame, rules: tuple[Rule, ...], default: str = "allow", url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict, method_rule and n_candidates to every row of ``urls``.

    Each rule is indexed under the literal token that the fewest urls hold; a
    url's tokens fetch the candidates and only those run their regular
    expressions.  Of the base rules that match the longest name decides, else
    the method's first (by name), else ``default``.  It is one narrow map over
    the rows: nothing is shuffled but the counts of the literals.

    A null url, or one without ``://``, has empty host and path, matches nothing
    and gets the default.  Repeated rows stay; input columns named like an
    added one are replaced.
    """
    if not 0 < len(rules) <= MAX_RULES:
        raise ValueError(f"between 1 and {MAX_RULES} rules")
    host, path = _host_path(F.col(url))
    split = urls.withColumns({"host": host, "path": path}).withColumn("_tokens", _tokens("host", "path"))
    counts = token_counts(split, sorted({t for r in rules for t in r.literals}))
    index: dict[str, list[Rule]] = {}
    for r in rules:
        if not r.literals:
            raise ValueError(f"rule {r.name} has no literal token to be found by")
        index.setdefault(min(r.literals, key=lambda t: (counts[t], -len(t), t)), []).append(r)
    entry = lambda r: F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"), F.lit(r.base).alias("base"))
    lookup = F.create_map(*[x for t, rs in sorted(index.items()) for x in (F.lit(t), F.array(*map(entry, rs)))])
    known = F.array(*[F.lit(t) for t in sorted(index)])
    fetched = F.flatten(F.transform(F.array_intersect("_tokens", known), lambda t: F.element_at(lookup, t)))
    matched = F.filter("_fetched", lambda r: F.rlike(F.concat("host", "path"), r["pattern"]))
    longest = lambda a: F.array_sort(a, lambda x, y: F.when(F.length(x["name"]) != F.length(y["name"]), F.length(y["name"]) - F.length(x["name"])).when(x["name"] < y["name"], -1).when(x["name"] > y["name"], 1).otherwise(0))
    return (
        split.withColumn("_fetched", fetched)
        .withColumn("_matched", matched)
        .withColumn("_base", F.get(longest(F.filter("_matched", lambda r: r["base"])), F.lit(0)))
        .withColumn("_own", F.get(F.array_sort(F.filter("_matched", lambda r: ~r["base"])), F.lit(0)))
        .withColumns(
            {
                "rule": F.col("_base.name"),
                "method_rule": F.col("_own.name"),
                "verdict": F.coalesce(F.col("_base.verdict"), F.col("_own.verdict"), F.lit(default)),
                "n_candidates": F.size("_fetched").cast("long"),
            }
        )
        .drop("_tokens", "_fetched", "_matched", "_base", "_own")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, BASE_RULES + METHOD_RULES).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    rule = lambda rs, out: "CASE " + " ".join(f"WHEN regexp_matches(host || path, '{r.pattern}') THEN '{getattr(r, out)}'" for r in rs) + " END"
    base = sorted(BASE_RULES, key=lambda r: -len(r.name))
    return f"""
    WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
    SELECT page_id, host, path, {rule(base, "name")} AS rule,
           coalesce({rule(base, "verdict")}, {rule(METHOD_RULES, "verdict")}, 'allow') AS verdict
    FROM parts"""


ORACLE = _oracle()
