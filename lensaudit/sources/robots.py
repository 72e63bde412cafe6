"""robots.txt: rule table and verdicts by the longest matching rule."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Paths of a site that one task judges.
SLICE = 50_000


def rules(robots: DataFrame) -> DataFrame:
    """Rows (site_id, agent, allow, pattern) of ``robots`` (site_id, body).

    Consecutive User-agent lines share a group; any other directive closes their list.
    Comments, blank lines and unknown directives are skipped, an empty pattern makes no rule.
    """
    lines = robots.select("site_id", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("pos", "raw"))
    line = F.trim(F.regexp_replace("raw", "#.*$", ""))
    key, value = F.lower(F.trim(F.split_part(line, F.lit(":"), F.lit(1)))), F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1))
    lines = lines.select("site_id", "pos", key.alias("key"), value.alias("value")).where(F.col("key").isin("user-agent", "allow", "disallow", "crawl-delay"))
    site = Window.partitionBy("site_id").orderBy("pos")  # one robots.txt
    agent = F.col("key") == "user-agent"
    lines = lines.withColumn("opens", agent & F.coalesce(F.lag("key").over(site) != "user-agent", F.lit(True)))
    lines = lines.withColumn("grp", F.sum(F.col("opens").cast("int")).over(site))
    agents = lines.where(agent).select("site_id", "grp", F.lower("value").alias("agent")).distinct()
    body = lines.where(F.col("key").isin("allow", "disallow") & (F.col("value") != "")).select("site_id", "grp", (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"))
    return agents.join(body, ["site_id", "grp"], "left").select("site_id", "agent", "allow", "pattern")


class Matcher:
    """The rules of one group, compiled: literal beginnings of patterns by their text, so that a path is compared
    only with patterns that begin as it does."""

    def __init__(self, rules: list[tuple[str, bool]]):
        self.by_head: dict[str, list[tuple[int, bool, list[str], bool]]] = {}
        for pattern, allow in dict.fromkeys(rules):
            closed = pattern.endswith("$")
            head, *rest = (pattern[:-1] if closed else pattern).split("*")
            self.by_head.setdefault(head, []).append((len(pattern), allow, rest, closed))
        for rules_ in self.by_head.values():
            rules_.sort(key=lambda r: r[:2], reverse=True)
        self.lengths = sorted({len(h) for h in self.by_head})

    def allows(self, path: str) -> bool:
        """By the longest pattern that matches, Allow on ties; True where none does."""
        best = (-1, True)
        for n in self.lengths:
            if n > len(path):
                break
            for length, allow, rest, closed in self.by_head.get(path[:n], ()):
                if (length, allow) <= best:
                    break
                if _fits(path, n, rest, closed):
                    best = (length, allow)
                    break
        return best[1]


def _fits(path: str, at: int, rest: list[str], closed: bool) -> bool:
    """Whether the parts between stars follow one another from ``at``, the last one at the end if ``closed``."""
    if not rest:
        return not closed or at == len(path)
    for part in rest[:-1] if closed else rest:
        at = path.find(part, at)
        if at < 0:
            return False
        at += len(part)
    return not closed or len(path) - len(rest[-1]) >= at and path.endswith(rest[-1])


def _chosen(token: str, agents: dict[str, list[tuple[str, bool]]]) -> list[tuple[str, bool]]:
    """Rules of the longest agents that the token contains, else those of ``*``."""
    low = token.lower()
    named = [a for a in agents if a not in ("", "*") and a in low]
    most = max(map(len, named), default=0)
    return [r for a in named if len(a) == most for r in agents[a]] if named else agents.get("*", [])


def verdicts(robots: DataFrame, asks: DataFrame) -> DataFrame:
    """Verdict of each row of ``asks`` (site_id, bot, token, path) under ``robots`` (site_id, body).

    The group of the longest agent name that the token contains holds, else that of ``*``.
    Among its rules the longest pattern that matches wins, and Allow wins ties. A null
    body (no robots.txt), no group and no match all mean allowed. The paths of a site are dealt
    into slices of about SLICE, each with the site's rules; a task compiles these once.
    """
    asked = asks.select("site_id", "bot", "token", "path")
    large = asked.groupBy("site_id").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices")).where("slices > 1")
    slices = F.coalesce("slices", F.lit(1))
    dealt = asked.join(large, "site_id", "left").select(*asked.columns, F.pmod(F.xxhash64("path", "token"), slices).cast("int").alias("slice"))
    there = robots.where(F.col("body").isNotNull())
    table = rules(there).unionByName(there.select("site_id", F.lit(None).cast("string").alias("agent"), F.lit(None).cast("boolean").alias("allow"), F.lit(None).cast("string").alias("pattern")))
    table = table.join(large, "site_id", "left").select("site_id", "agent", "allow", "pattern", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    out = pa.schema([("site_id", pa.string()), ("bot", pa.string()), ("token", pa.string()), ("path", pa.string()), ("verdict", pa.string()), ("robots_present", pa.bool_())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        agents: dict[str, list[tuple[str, bool]]] = {}
        for agent, allow, pattern in zip(*(left[c].to_pylist() for c in ("agent", "allow", "pattern"))):
            if agent is not None:
                agents.setdefault(agent, []).extend([(pattern, allow)] if pattern is not None else [])
        tokens = right["token"].to_pylist()
        compiled = {t: Matcher(_chosen(t or "", agents)) for t in set(tokens)}
        said = ["allowed" if p is None or compiled[t].allows(p) else "blocked" for t, p in zip(tokens, right["path"].to_pylist())]
        cols = [right[c].cast(out.field(c).type) for c in ("site_id", "bot", "token", "path")]
        return pa.Table.from_arrays([*cols, pa.array(said, pa.string()), pa.array([left.num_rows > 0] * right.num_rows)], schema=out)

    # both sides may come from one table: columns of their own
    table, dealt = (x.select(*(F.col(n).alias(n) for n in x.columns)) for x in (table, dealt))
    pairs = table.groupBy("site_id", "slice").cogroup(dealt.groupBy("site_id", "slice"))
    return pairs.applyInArrow(run, "site_id string, bot string, token string, path string, verdict string, robots_present boolean")


def sitemaps(robots: DataFrame) -> DataFrame:
    """(site_id, pos, url) of the Sitemap lines."""
    lines = robots.select("site_id", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("pos", "raw"))
    url = F.trim(F.regexp_extract("raw", r"(?i)^\s*sitemap\s*:(.*)$", 1))
    return lines.select("site_id", "pos", url.alias("url")).where("url <> ''")


def posture(verdict_rows: DataFrame) -> DataFrame:
    """blocked, partial or allowed over all bots of a site."""
    blocked = F.col("verdict") == "blocked"
    return verdict_rows.groupBy("site_id").agg(F.when(F.bool_and(blocked), "blocked").when(F.bool_or(blocked), "partial").otherwise("allowed").alias("posture"))
