"""Commits that sessions saw, found again after a rebase or an amendment; and the sessions that a repository's evidence comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.functions.scalars import line_digest
from lagoon.operators.changes import remote_key
from lagoon.operators.lineage import closure
from lagoon.storage import materialize

#: Least length of a revision that names a commit by its beginning, and of one at all.
PREFIX, SHORTEST = 7, 4


def _sections(text: Column) -> Column:
    """The files of a unified diff in their order: ``path`` and ``lines``, the hunks' lines with their signs; places of hunks, modes and object names are left out."""
    def section(one: Column) -> Column:
        lines = F.split(one, "\n")
        path = F.when(one.startswith("diff --git "), F.regexp_extract(F.element_at(lines, 1), r" b/(.+)$", 1))
        # a hunk tells how many lines it has, but its first line after the header of a file is enough here: headers end with the first @@
        begun = F.array_position(F.transform(lines, lambda x: x.startswith("@@ ")), True).cast("int")
        inside = F.when(begun > 0, F.slice(lines, F.greatest(begun, F.lit(1)), F.size(lines))).otherwise(F.slice(lines, 1, 0))
        return F.struct(path.alias("path"), F.filter(inside, lambda x: F.substring(x, 1, 1).isin("+", "-", " ")).alias("lines"))

    return F.transform(F.split(text, "\n(?=diff --git )"), section)


def patch_ids(diffs: DataFrame, key: str = "sha", text: str = "diff") -> DataFrame:
    """``key, patch_id``: a digest of what a diff changes: by file its hunks' lines with their signs, blanks left out; where the hunks stand and in which order the files come doesn't count.

    A diff without a hunk has none. Each diff is one value and read in its row: nothing is shuffled.
    """
    bare = lambda x: F.sha2(F.concat(F.substring(x, 1, 1), F.regexp_replace(F.substring(x, 2, 1 << 30), r"\s+", "")), 256)
    held = diffs.select(key, F.filter(_sections(F.col(text)), lambda s: F.size(s["lines"]) > 0).alias("s")).filter(F.size("s") > 0)
    same = lambda p: F.flatten(F.transform(F.filter("s", lambda s: s["path"].eqNullSafe(p)), lambda s: F.transform(s["lines"], bare)))
    files = F.transform(F.array_distinct(F.transform("s", lambda s: s["path"])), lambda p: F.sha2(F.concat_ws("", F.array(p), same(p)), 256))
    return held.select(key, F.sha2(F.concat_ws("", F.array_sort(files)), 256).alias("patch_id"))


def added_lines(diffs: DataFrame, key: str = "sha", text: str = "diff") -> DataFrame:
    """``key, digests``: distinct digests of the lines that a diff adds; lines of punctuation and space alone have none."""
    lines = F.flatten(F.transform(_sections(F.col(text)), lambda s: s["lines"]))
    each = F.transform(F.filter(lines, lambda x: x.startswith("+")), lambda x: line_digest(F.substring(x, 2, 1 << 30)))
    return diffs.select(key, F.array_distinct(F.array_compact(each)).alias("digests"))


def resolve_observed(observed: DataFrame, commits: DataFrame, objects: DataFrame, share: float = 0.5) -> DataFrame:
    """``session, revision, sha, how, reason``: the commit of the set that each observed revision stands for.

    ``observed``: session, revision. ``commits`` (the set) and ``objects`` (what can still be read outside of it): sha, diff. A revision is found ``exact`` where it is the beginning (seven characters or more) of one commit's
    name; else, if one object has it, as ``patch-equivalent``: the one commit of the same patch id (rebased); else by ``line-majority``: the one commit that adds more than ``share`` of the object's lines
    and more than any other (amended). Otherwise ``sha`` is null with a reason: not-a-revision, ambiguous (several as good), missing (no object), no-equivalent.
    """
    asked = observed.select("session", F.lower(F.trim("revision")).alias("revision")).distinct()
    names = asked.select("revision").distinct()
    sound = names.filter(F.col("revision").rlike(f"^[0-9a-f]{{{SHORTEST},64}}$"))
    known = commits.select("sha", F.substring("sha", 1, PREFIX).alias("k"))
    long = sound.filter(F.length("revision") >= PREFIX).withColumn("k", F.substring("revision", 1, PREFIX))
    exact = long.join(known, "k").filter(F.col("sha").startswith(F.col("revision"))).groupBy("revision").agg(F.min("sha").alias("sha"), F.count("*").alias("n"))
    exact = exact.select("revision", F.when(F.col("n") == 1, F.col("sha")).alias("sha"), F.lit("exact").alias("how"), F.when(F.col("n") > 1, "ambiguous").alias("reason"))

    left = sound.join(exact, "revision", "left_anti")
    # names meet names by seven characters where they have them: by four, pairs would grow with the square of the names
    met = None
    for size, some in ((PREFIX, F.length("revision") >= PREFIX), (SHORTEST, F.length("revision") < PREFIX)):
        there = objects.select(F.col("sha").alias("object"), F.substring("sha", 1, size).alias("k"))
        pairs = left.filter(some).withColumn("k", F.substring("revision", 1, size)).join(there, "k").filter(F.col("object").startswith(F.col("revision"))).select("revision", "object")
        met = pairs if met is None else met.unionByName(pairs)
    met = materialize(met.groupBy("revision").agg(F.min("object").alias("object"), F.count("*").alias("m")))
    one = met.filter("m = 1").select("revision", "object")
    several = met.filter("m > 1").select("revision", F.lit(None).cast("string").alias("sha"), F.lit(None).cast("string").alias("how"), F.lit("ambiguous").alias("reason"))

    mine = one.join(patch_ids(objects).withColumnRenamed("sha", "object"), "object")
    same = mine.join(patch_ids(commits).withColumnRenamed("sha", "found"), "patch_id").groupBy("revision").agg(F.min("found").alias("sha"), F.count_distinct("found").alias("n"))
    patched = materialize(same.select("revision", F.when(F.col("n") == 1, F.col("sha")).alias("sha"), F.lit("patch-equivalent").alias("how"), F.when(F.col("n") > 1, "ambiguous").alias("reason")))

    rest = one.join(patched, "revision", "left_anti").join(added_lines(objects).withColumnRenamed("sha", "object"), "object")
    lines = rest.select("revision", F.size("digests").alias("all"), F.explode("digests").alias("digest"))
    added = added_lines(commits).select(F.col("sha").alias("found"), F.explode("digests").alias("digest"))
    votes = lines.join(added, "digest").groupBy("revision", "found", "all").agg(F.count_distinct("digest").alias("common")).filter(F.col("common") > share * F.col("all"))
    best = votes.groupBy("revision").agg(F.max("common").alias("top"))
    first = votes.join(best, "revision").filter("common = top").groupBy("revision").agg(F.min("found").alias("sha"), F.count("*").alias("n"))
    voted = first.select("revision", F.when(F.col("n") == 1, F.col("sha")).alias("sha"), F.lit("line-majority").alias("how"), F.when(F.col("n") > 1, "ambiguous").alias("reason"))

    found = exact.unionByName(several).unionByName(patched).unionByName(voted)
    odd = F.when(~F.col("revision").rlike(f"^[0-9a-f]{{{SHORTEST},64}}$"), "not-a-revision").when(F.col("there").isNull(), "missing").otherwise("no-equivalent")
    held = one.select(F.col("revision").alias("r"), F.lit(True).alias("there"))
    told = names.join(found, "revision", "left").join(held, F.col("revision") == F.col("r"), "left")
    told = told.select("revision", "sha", F.when(F.col("sha").isNotNull(), F.col("how")).alias("how"), F.when(F.col("sha").isNull(), F.coalesce("reason", odd)).alias("reason"))
    return asked.join(told, "revision").select("session", "revision", "sha", "how", "reason")


def gather(sessions: DataFrame, locations: DataFrame, observed: DataFrame, lineage: DataFrame, worktrees: DataFrame, remotes: DataFrame, commits: DataFrame, since: str, until: str) -> DataFrame:
    """``session, rules, depth``: the sessions active in [since, until] whose evidence touches a repository, and their descendants.

    ``sessions``: session, started, last_activity. ``locations``: session, at, directory, remote, held (null: whether the directory is the repository's can't be told any more). ``observed``: session, at, sha, created. ``lineage``: session, parent.
    The listing alone decides who is a candidate; evidence is read of candidates only. Rules: ``location`` (a directory in a worktree), ``remote`` (an address of the repository, whatever its form), ``commit`` (a revision that
    names one of its commits), ``placed`` (a directory that can't be told, where a session with the remote worked, or one that created such a commit just then). Descendants of members are members (``lineage``, depth above 0).
    """
    low, high = (F.lit(x).cast("timestamp_ntz") for x in (since, until))
    candidates = sessions.filter((F.col("started").isNull() | (F.col("started") <= high)) & (F.col("last_activity").isNull() | (F.col("last_activity") >= low))).select("session")
    at = locations.join(candidates, "session", "left_semi")
    # paths meet worktrees by their beginnings: each step of a path is a key
    steps = F.transform(F.sequence(F.lit(1), F.size(F.split("directory", "/"))), lambda n: F.array_join(F.slice(F.split("directory", "/"), 1, n), "/"))
    inside = at.select("session", F.explode(steps).alias("step")).join(worktrees.select(F.col("path").alias("step")).distinct(), "step", "left_semi")
    keyed = at.filter("remote IS NOT NULL").withColumn("key", remote_key(F.col("remote")))
    known = remotes.select(remote_key(F.col("remote")).alias("key")).distinct()
    linked = keyed.join(known, "key", "left_semi").select("session").distinct()
    seen = observed.join(candidates, "session", "left_semi").withColumn("k", F.substring("sha", 1, PREFIX))
    named = seen.join(commits.select(F.col("sha").alias("full"), F.substring("sha", 1, PREFIX).alias("k")), "k").filter(F.col("full").startswith(F.col("sha")))
    # where a session was when it created a commit: the last place at or before it
    marks = named.filter("created").select("session", F.col("at").alias("t"), F.lit(1).alias("turn"), F.lit(None).cast("string").alias("directory"), F.lit(None).cast("boolean").alias("held"))
    places = at.select("session", F.col("at").alias("t"), F.lit(0).alias("turn"), "directory", "held")
    by = Window.partitionBy("session").orderBy(F.col("t").asc_nulls_first(), "turn").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("turn") == 0, F.struct("directory", "held")), ignorenulls=True).over(by)
    made_at = marks.unionByName(places).withColumn("x", last).filter("turn = 1 AND t IS NOT NULL AND x IS NOT NULL AND x.held IS NULL").select(F.col("x.directory").alias("directory"))
    unknown = at.filter("held IS NULL")
    placed = made_at.unionByName(unknown.join(linked, "session", "left_semi").select("directory")).distinct()
    there = unknown.join(placed, "directory", "left_semi")
    rules = {"location": inside, "remote": linked, "commit": named, "placed": there}
    members = None
    for rule, found in rules.items():
        one = found.select("session", F.lit(rule).alias("rule"))
        members = one if members is None else members.unionByName(one)
    own = members.groupBy("session").agg(F.array_sort(F.collect_set("rule")).alias("rules"))  # four rules
    family = closure(lineage, own.select("session"))
    return family.join(own, "session", "left").select("session", F.coalesce("rules", F.array(F.lit("lineage"))).alias("rules"), "depth")
