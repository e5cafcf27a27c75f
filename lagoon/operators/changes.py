"""Commands, diffs, commits and the work they belong to."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.functions.scalars import line_digest

INVOCATIONS = "array<struct<separator:string,program:string,words:array<string>>>"


def command_text(arguments: Column) -> Column:
    """What a shell call ran: its ``command`` or ``cmd``, a list joined by blanks, or the raw arguments."""
    found = F.coalesce(F.get_json_object(arguments, "$.command"), F.get_json_object(arguments, "$.cmd"))
    listed = F.array_join(F.from_json(found, "array<string>"), " ")
    return F.coalesce(F.when(found.startswith("["), listed), found, arguments)


def ran(arguments: Column, needle: str) -> Column:
    """Whether the command holds the needle, case aside."""
    return F.coalesce(F.lower(command_text(arguments)).contains(needle.lower()), F.lit(False))


def split_command(line: str, most: int = 32) -> list[tuple[str, list[str]]]:
    """``(separator, words)`` of each simple command: quotes and escapes taken off, comments, redirections and the bodies of here-documents left out."""
    out: list[tuple[str, list[str]]] = []
    words, word, quoted, sep, ends, i = [], "", False, "", [], 0

    def close() -> None:
        nonlocal word, quoted
        if word or quoted:
            words.append(word)
        word, quoted = "", False

    def command(after: str) -> None:
        nonlocal words, sep
        close()
        if words:
            out.append((sep, words))
        words, sep = [], after

    while i < len(line):
        c = line[i]
        if c == "\\" and i + 1 < len(line):
            word += "" if line[i + 1] == "\n" else line[i + 1]
            i += 1
        elif c in "'\"":
            end = i + 1
            while end < len(line) and line[end] != c:
                if c == '"' and line[end] == "\\" and end + 1 < len(line):
                    end += 1
                word += line[end]
                end += 1
            i, quoted = end, True
        elif c == "#" and not word and not quoted:
            i = line.find("\n", i) - 1 if "\n" in line[i:] else len(line)
        elif line.startswith("<<", i) and not line.startswith("<<<", i):
            close()
            end = i + 2
            while end < len(line) and line[end] in "- ":
                end += 1
            begun = end
            while end < len(line) and line[end] not in " \n;|&":
                end += 1
            ends.append(line[begun:end].strip("'\""))
            i = end - 1
        elif c in "<>":
            if word.isdigit():
                word = ""
            close()
            i += 1
            while i < len(line) and line[i] in ">&| ":
                i += 1
            while i < len(line) and line[i] not in " \n;|&":
                i += 1
            i -= 1
        elif c == "\n":
            command(";")
            while ends:
                stop = ends.pop(0)
                rest = line[i + 1 :].split("\n")
                gone = next((k for k, x in enumerate(rest) if x.strip() == stop), len(rest) - 1)
                i += sum(len(x) + 1 for x in rest[: gone + 1])
        elif c in ";|&":
            two = line[i : i + 2]
            command(two if two in ("&&", "||") else c)
            i += two in ("&&", "||")
        elif c in " \t":
            close()
        else:
            word += c
        i += 1
    command("")
    return out[:most]


def _program(words: list[str]) -> list[str]:
    """Words from the program on: assignments and the usual wrappers before it left out."""
    k = 0
    while k < len(words) and (("=" in words[k] and words[k].split("=")[0].isidentifier()) or words[k] in ("sudo", "env", "time", "nohup", "exec")):
        k += 1
    return words[k:]


def invocations(events: DataFrame, keys: list[str], arguments: str = "arguments", most: int = 32) -> DataFrame:
    """``keys, invocations``: the programs that each call's command runs, those of ``sh -c`` scripts included, at most ``most``."""
    given = events.select(*keys, command_text(F.col(arguments)).alias("__line"))
    kinds = [f"`{k}` {given.schema[k].dataType.simpleString()}" for k in keys]

    def nested(line: str, depth: int = 0) -> list[tuple[str, list[str]]]:
        found = []
        for sep, words in split_command(line, most):
            words = _program(words)
            if words:
                found.append((sep, words))
                if depth < 4 and words[0].rsplit("/", 1)[-1] in ("sh", "bash", "zsh") and len(words) > 2 and words[1].startswith("-") and "c" in words[1]:
                    found += nested(words[2], depth + 1)
        return found[:most]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("separator", pa.string()), ("program", pa.string()), ("words", pa.list_(pa.string()))]))
        for batch in batches:
            last = batch.num_columns - 1
            made = [[{"separator": s, "program": w[0].rsplit("/", 1)[-1], "words": w} for s, w in nested(x)] if x else [] for x in batch.column(last).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(last)), pa.array(made, kind)], names=[*keys, "invocations"])

    return given.mapInArrow(run, ", ".join([*kinds, f"invocations {INVOCATIONS}"]))


def ran_program(invoked: Column, name: str) -> Column:
    return F.exists(invoked, lambda x: x["program"] == name)


def commit_observations(outputs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, sha, kind, subject``: revisions that tools printed: created by ``[branch sha] subject`` lines, inspected by ``commit sha`` lines."""
    lines = outputs.select(*keys, F.posexplode(F.split(text, "\n")).alias("line", "value"))
    made, seen = r"^\[[^\]\s]+(?: \(root-commit\))? ([0-9a-f]{7,40})\] (.*)$", r"^commit ([0-9a-f]{40})\b"
    found = lines.select(
        *keys, "line",
        F.when(F.col("value").rlike(made), F.struct(F.regexp_extract("value", made, 1).alias("sha"), F.lit("created").alias("kind"), F.regexp_extract("value", made, 2).alias("subject")))
        .when(F.col("value").rlike(seen), F.struct(F.regexp_extract("value", seen, 1).alias("sha"), F.lit("inspected").alias("kind"), F.lit(None).cast("string").alias("subject"))).alias("x"),
    ).filter("x IS NOT NULL")
    return found.select(*keys, "line", "x.*")


def patched_lines(patches: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, line, path, op, sign, digest``: lines that a patch adds or removes, in ``*** Update File:`` patches and unified diffs alike."""
    lines = patches.select(*keys, F.posexplode(F.split(text, "\n")).alias("line", "value"))
    head = r"^\*\*\* (Add|Update|Delete) File: (.+)$"
    target = F.when(F.col("value").rlike(head), F.struct(F.regexp_extract("value", head, 2).alias("path"), F.lower(F.regexp_extract("value", head, 1)).alias("op"))).when(
        F.col("value").rlike(r"^\+\+\+ (b/)?.+$"), F.struct(F.regexp_extract("value", r"^\+\+\+ (?:b/)?(.+)$", 1).alias("path"), F.lit("update").alias("op"))
    )
    by = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    inside = lines.withColumn("t", F.last(target, ignorenulls=True).over(by))
    sign = F.substring("value", 1, 1)
    changed = inside.filter("t IS NOT NULL").filter(sign.isin("+", "-") & ~F.col("value").rlike(r"^(\+\+\+|---)( |$)"))
    return changed.select(*keys, "line", "t.path", "t.op", sign.alias("sign"), line_digest(F.expr("substring(value, 2)")).alias("digest"))


def edited_digests(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, path, op, added, removed``: distinct digests that each edit adds and removes in a file."""
    return lines.groupBy(*keys, "path", "op").agg(
        F.array_sort(F.collect_set(F.when(F.col("sign") == "+", F.col("digest")))).alias("added"), F.array_sort(F.collect_set(F.when(F.col("sign") == "-", F.col("digest")))).alias("removed")
    )


def trailers(message: Column) -> Column:
    """``key, value`` of the trailers in a message's last paragraph, where every line of it is one."""
    paragraphs = F.split(F.regexp_replace(message, r"\s+$", ""), r"\n[ \t]*\n")
    lines = F.split(F.element_at(paragraphs, -1), "\n")
    pattern = r"^([A-Za-z][A-Za-z0-9-]*): (.+)$"
    all_are = F.forall(lines, lambda x: x.rlike(pattern)) & (F.size(paragraphs) > 1)
    found = F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, pattern, 1)).alias("key"), F.regexp_extract(x, pattern, 2).alias("value")))
    return F.when(all_are, found).otherwise(F.array().cast("array<struct<key:string,value:string>>"))


def remote_key(url: Column) -> Column:
    """``host/path`` of a repository's address whatever its form: scheme, user, port, ``.git`` and a slash at the end don't count, the host's case neither."""
    plain = F.regexp_replace(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    scp = ~url.contains("://")
    plain = F.regexp_replace(plain, r"^[^@/]*@", "")
    plain = F.when(scp, F.regexp_replace(plain, r"^([^/:]+):/*", "$1/")).otherwise(F.regexp_replace(plain, r"^([^/:]+):[0-9]+", "$1"))
    plain = F.regexp_replace(F.regexp_replace(plain, r"/+$", ""), r"\.git$", "")
    return F.concat(F.lower(F.regexp_extract(plain, r"^([^/]*)", 1)), F.regexp_extract(plain, r"^[^/]*(.*)$", 1))


def estimate_windows(requests: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """``work`` of each request by the events of its stretch: the next one at or after it, else the last before it; null in a stretch without any.

    ``requests``: keys (a stretch), at. ``events``: keys, at, work. One ordered pass over both; of events at one time the first by name counts.
    """
    rows = requests.select(*keys, "at", F.lit(None).cast("string").alias("work"), F.lit(1).alias("__k"), F.struct(*[F.col(c) for c in requests.columns]).alias("__row"))
    marks = events.select(*keys, "at", "work", F.lit(2).alias("__k"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"))
    by, back = ("at", "__k", "work"), (F.desc("at"), F.desc("__k"), F.desc("work"))
    behind, ahead = (F.last("work", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*o).rowsBetween(Window.unboundedPreceding, 0)) for o in (by, back))
    both = rows.unionByName(marks).withColumn("__w", F.coalesce(ahead, behind)).filter("__k = 1")
    return both.select("__row.*", F.col("__w").alias("work"))


def commit_claims(evidence: DataFrame) -> DataFrame:
    """``session, commit, tier, basis``: the strongest evidence that ties a session to a commit: bound, matched, estimated; ties to the earlier basis by name."""
    rank = F.when(F.col("tier") == "bound", 0).when(F.col("tier") == "matched", 1).when(F.col("tier") == "estimated", 2)
    return evidence.groupBy("session", "commit").agg(F.min(F.struct(rank.alias("r"), "basis", "tier")).alias("m")).select("session", "commit", "m.tier", "m.basis")


def evidence_conflicts(records: DataFrame) -> DataFrame:
    """``label, commits, status``: labels of evidence records that name one commit, several (a conflict) or none."""
    return records.groupBy("label").agg(F.count_distinct("commit").alias("commits"), F.when(F.count_distinct("commit") > 1, "conflict").when(F.count_distinct("commit") == 1, "placed").otherwise("unplaced").alias("status"))


def evidence_records(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """``(records, malformed)`` of evidence files: one JSON object a line, the first a header; lines that aren't of a known type are reported by number.

    ``lines``: file, line, value.
    """
    parsed = lines.withColumn("r", F.from_json("value", schema))
    good = F.coalesce(F.col("r.type").isin("header", "lineage", "binding", "event"), F.lit(False)) & ((F.col("r.type") == "header") == (F.col("line") == 0))
    return parsed.filter(good).select("file", "line", "r.*"), parsed.filter(~good).select("file", "line")


def change_usage(placed: DataFrame, dims: list[str]) -> DataFrame:
    """Consumption by dimensions of the commits, with the totals of what is uncommitted, unattributed, labelled and unselected, and of all."""
    of = F.when(F.col("commit").isNotNull() & F.col("selected"), "commit").when(F.col("commit").isNotNull(), "unselected").when(F.col("label").isNotNull(), "labelled").when(F.col("uncommitted"), "uncommitted").otherwise("unattributed")
    rows = placed.withColumn("share", of).withColumns({d: F.when(F.col("share") == "commit", F.col(d)) for d in dims})
    cube = rows.groupingSets([[F.col("share"), *[F.col(d) for d in dims]], [F.col("share")], []], F.col("share"), *[F.col(d) for d in dims])
    return cube.agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("requests"), F.sum("input").alias("input"), F.sum("output").alias("output"))


def pull_request_rule(requests: DataFrame) -> DataFrame:
    """``rule``: how the commits of a pull request are chosen, by its state and by what its merge left.

    ``requests``: state (open, closed, merged), parents (of the merge commit), same_tree (its tree is the head's on the base), commits (of the branch), picked (commits on the base whose patch
    equals one of the branch).
    """
    rule = (
        F.when(F.col("state") == "open", "open").when(F.col("state") == "closed", "closed")
        .when(F.col("parents") >= 2, "merge-commit")
        .when((F.col("parents") == 1) & (F.col("commits") > 1) & (F.col("picked") == F.col("commits")), "rebase")
        .when((F.col("parents") == 1) & F.col("same_tree"), "squash")
        .otherwise("unrecognized")
    )
    return requests.withColumn("rule", rule)
