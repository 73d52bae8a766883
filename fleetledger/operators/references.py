"""Which files a plan's text names.

A token names a file when one of the two is a tail of the other, in whole segments. Both cases are equi-joins on a
path written as text: files meet tokens on the files' tails, and tokens that are no file's tail meet whole paths on
their own tails. Tails are counted before they are joined, so a basename that very many files share is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetledger.functions.binding import unnest
from fleetledger.functions.paths import infer_purpose, is_path_shaped, path_tokens, segments
from fleetledger.functions.text import token_estimate_from_size


def tails(parts: Column) -> Column:
    """Every tail of a path's segments with its size, the whole path first."""
    size = F.size(parts)
    return F.transform(
        F.sequence(F.lit(1), F.greatest(size, F.lit(1))),
        lambda i: F.struct(
            F.array_join(F.slice(parts, i, size), "/").alias("tail"), (size - i + 1).alias("size")
        ),
    )


def _whole_paths(files: DataFrame) -> DataFrame:
    """Each file with its segments joined by single slashes."""
    parts = segments(F.col("path"))
    return files.select("repo_id", "path", parts.alias("parts")).where(F.size("parts") > 0)


def _file_tails(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """A row per tail of each file, at most as many as the path is deep."""
    return unnest(_whole_paths(files), ["repo_id", "path", *(keep or [])], tails(F.col("parts")))


def _tokens(text: Column) -> Column:
    """The path tokens of a text, as text."""
    return F.array_distinct(F.transform(path_tokens(text), lambda t: F.array_join(t, "/")))


def _own_tails(tokens: DataFrame, keep: list[str]) -> DataFrame:
    """The proper tails of each token."""
    return unnest(tokens, [*keep, "token"], tails(F.split("token", "/"))).where("tail <> token")


def _shortest(tokens: Column) -> Column:
    """The tokens of which no proper tail is a token itself."""

    def shorter(token: Column) -> Column:
        parts = F.split(token, "/")
        return F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))

    return F.filter(tokens, lambda t: F.when(t.contains("/"), ~F.arrays_overlap(shorter(t), tokens)).otherwise(True))


def text_targets(texts: DataFrame, files: DataFrame, keep: list[str]) -> DataFrame:
    """``repo_id, *keep, path``: distinct files that a token of each text names; a token that is a tie names nothing.

    A token that is a tail of files agrees with these in full, and no file can agree with more of it: one such file is
    named, several are a tie. A token that is no file's tail names the file whose whole path is its longest tail. Every
    token meets the counted tails of all files once, with its own tails beside it, and the longest that counts decides.
    """
    key = ["repo_id", *keep]
    tokens = unnest(texts, key, _tokens(F.col("text")), ["token"])
    # a tail meets the files with what its token has before it, not with the token beside it
    before = F.expr("left(token, length(token) - length(tail))").alias("before")
    tried = unnest(tokens, [*key, "token"], tails(F.split("token", "/"))).select(*key, "tail", "size", before)
    whole = F.col("tail") == F.array_join("parts", "/")
    counted = _file_tails(files, ["parts"]).groupBy("repo_id", "tail").agg(
        F.count("*").alias("n"), F.min("path").alias("path"),
        F.count_if(whole).alias("whole_n"), F.min(F.when(whole, F.col("path"))).alias("whole_path"),
    )
    own = F.col("before") == ""
    met = tried.join(counted, ["repo_id", "tail"]).where(own | (F.col("whole_n") > 0))
    best = F.struct(F.when(own, F.col("n")).otherwise(F.col("whole_n")).alias("n"), F.when(own, F.col("path")).otherwise(F.col("whole_path")).alias("path"))
    return (
        met.select(*key, F.concat("before", "tail").alias("token"), "size", best.alias("best"))
        .repartition(*key)
        .groupBy(*key, "token")
        .agg(F.max_by("best", "size").alias("best"))
        .where("best.n = 1")
        .select(*key, F.col("best.path").alias("path"))
        .distinct()
    )


def open_texts(chunks: DataFrame, tasks: DataFrame) -> DataFrame:
    """Texts that may name files: unfinished tasks, and planned paths of chunks that are not finished.

    ``chunks`` has ``repo_id, chunk_id, files``; ``tasks`` has ``chunk_id, text, status``.
    """
    finished = tasks.groupBy("chunk_id").agg(F.bool_and(F.col("status") == "done").alias("finished"))
    pending = tasks.where("status <> 'done'").join(chunks.select("repo_id", "chunk_id"), "chunk_id")
    planned = (
        chunks.join(finished, "chunk_id", "left")
        .where(~F.coalesce("finished", F.lit(False)))
        .select("repo_id", "chunk_id", F.explode("files").alias("text"))
    )
    return pending.select("repo_id", "chunk_id", "text").unionByName(planned)


def referenced_files(texts: DataFrame, files: DataFrame) -> DataFrame:
    """``repo_id, path, chunk_id``: distinct chunks whose open texts name each file."""
    return text_targets(texts, files, ["chunk_id"]).select("repo_id", "path", "chunk_id")


def mentions(texts: DataFrame, files: DataFrame, keep: list[str]) -> DataFrame:
    """Files each text mentions, without asking that the mention be unique.

    The result has a row for each text and file, so a text that says ``index.ts`` has as many as there are such files:
    that expansion is what is asked for, and nothing is shuffled after it. What a token names, a proper tail of it names
    too, so a text's shortest tokens are enough; two of these are tails of no common file, so no row comes twice. A file
    can only be a tail of several of them, and only those rows, few a token, are made distinct. The tokens of one text
    are gathered.
    """
    key = ["repo_id", *keep]
    gathered = unnest(texts, key, _tokens(F.col("text")), ["token"]).groupBy(*key).agg(F.collect_set("token").alias("tokens"))
    tokens = unnest(gathered, key, _shortest(F.col("tokens")), ["token"])
    paths = files.select("repo_id", "path").distinct()
    within = tokens.join(_file_tails(paths).select("repo_id", F.col("tail").alias("token"), "path"), ["repo_id", "token"])
    whole = _whole_paths(paths).select("repo_id", "path", F.array_join("parts", "/").alias("tail"))
    around = _own_tails(tokens.where(F.col("token").contains("/")), key).join(whole, ["repo_id", "tail"])
    return within.select(*key, "path").unionByName(around.select(*key, "path").distinct())


def plan_tags(references: DataFrame, files: DataFrame, always_include: DataFrame) -> DataFrame:
    """An index row per (referenced file, chunk), always-included files left out."""
    key = ["repo_id", "path"]
    return (
        references.join(always_include.select(*key), key, "left_anti")
        .join(files.select(*key, "size_bytes"), key)
        .select(
            *key,
            "chunk_id",
            infer_purpose(F.col("path")).alias("purpose"),
            token_estimate_from_size(F.col("size_bytes")).alias("token_cost"),
        )
    )


def absent_paths(planned: DataFrame, known: DataFrame, inventory: DataFrame) -> DataFrame:
    """Planned paths that are new: in a directory, path-shaped, no tail of a known file, not on disk."""
    wanted = planned.where(F.col("path").contains("/") & is_path_shaped(F.col("path")))
    known_tails = unnest(known.select("repo_id", "path"), ["repo_id"], tails(F.split("path", "/")))
    # a wanted path has a slash, so no basename can be one
    named = known_tails.where(F.col("tail").contains("/")).select("repo_id", F.col("tail").alias("path")).distinct()
    fresh = wanted.join(named, ["repo_id", "path"], "left_anti")
    return fresh.join(inventory.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_anti")


def neighbours(absent: DataFrame, indexed: DataFrame, taken: DataFrame, per_path: int = 3, per_chunk: int = 8) -> DataFrame:
    """Indexed files beside each absent path, in the closest directory that has any.

    ``absent`` has ``repo_id, chunk_id, path, path_no``. Picks of one chunk depend on its earlier picks,
    so the final choice walks the chunk's candidates in order. Every absent path brings at most ``per_chunk`` +
    ``per_path`` candidates to it, enough to survive all earlier picks.
    """
    from fleetledger.functions.paths import dirname, extname

    parts = F.split("path", "/")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir")),
    )
    above = unnest(
        absent.where(F.col("path").contains("/")), ["repo_id", "chunk_id", "path", "path_no"], ancestors
    )
    beside = indexed.select("repo_id", F.col("path").alias("file"), dirname(F.col("path")).alias("dir"))
    dirs = beside.select("repo_id", "dir").distinct()
    closest = (
        above.join(dirs, ["repo_id", "dir"])
        .groupBy("repo_id", "chunk_id", "path", "path_no")
        .agg(F.max_by("dir", "depth").alias("dir"))
    )
    free = beside.join(taken.select("repo_id", F.col("path").alias("file")), ["repo_id", "file"], "left_anti")
    # what a directory offers depends on the extension asked for alone: ranked once for each, and met by every path
    sought = closest.withColumn("ext", extname(F.col("path")))
    order = Window.partitionBy("repo_id", "dir", "ext").orderBy((extname(F.col("file")) != F.col("ext")).cast("int"), "file")
    offered = (
        sought.select("repo_id", "dir", "ext").distinct().join(free, ["repo_id", "dir"])
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= per_path + per_chunk)
    )
    candidates = sought.join(offered, ["repo_id", "dir", "ext"]).select("repo_id", "chunk_id", "path_no", "path", "file", "rank")

    def pick(acc: Column, c: Column) -> Column:
        full = F.size(acc) >= per_chunk
        used = F.exists(acc, lambda p: p["file"] == c["file"])
        beside_path = F.size(F.filter(acc, lambda p: p["path_no"] == c["path_no"]))
        row = F.struct(c["path_no"].alias("path_no"), c["path"].alias("path"), c["file"].alias("file"))
        return F.when(full | used | (beside_path >= per_path), acc).otherwise(F.concat(acc, F.array(row)))

    per_plan = candidates.groupBy("repo_id", "chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("path_no", "rank", "path", "file"))).alias("found")
    )
    none = F.array().cast("array<struct<path_no:int,path:string,file:string>>")
    picked = unnest(per_plan, ["repo_id", "chunk_id"], F.aggregate("found", none, pick))
    return picked.select("repo_id", "chunk_id", "path", "file")
