"""Directory trees as inventories.

Listing goes level by level: one Spark job lists all folders of a level, spread over the
tasks one by one, and writes the level as a table.  A huge subtree is thus split again at
every level instead of being one task, a folder with very many entries is dealt in shares to several
tasks, and nothing but the loop runs on the driver.  Sizes and times are read in a later pass spread
over files; hashes, modes and owners are columns that are worked out only where they are asked for.
All executors must see the tree under the same path.
"""

from __future__ import annotations

import os
import stat
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filecensus.functions import paths, text
from filecensus.operators import classify as C
from filecensus.operators import contents, filters, hashing, permissions
from filecensus.operators import rules as R
from filecensus.operators.lookup import lookup_join
from filecensus.operators.secrets import flag_embedded_secrets
from filecensus.session import work_dir

try:
    import grp
    import pwd
except ImportError:
    grp = pwd = None

ENTRY = (
    "path string, filename string, is_directory boolean, is_symlink boolean, is_file boolean, error string, "
    "shares int, above array<string>, leads_back boolean"
)
STAT = (
    "size_bytes bigint, total_bytes bigint, modified_timestamp double, target_is_directory boolean, stat_error string"
)
ACCESS = T.StructType(
    [T.StructField("mode", T.IntegerType()), T.StructField("owner", T.StringType()), T.StructField("group", T.StringType())]
)
#: Bytes of a folder's own entry list per share of its listing, some ten thousand names.
SHARE_BYTES = 1 << 20
BATCH_ROWS = 5000
CHUNK_BYTES = 65536
RANGE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20


def folder_entries(
    folder: str, share: int = 0, shares: int = 1, above: tuple[str, ...] | list[str] = (),
    follow_symlinks: bool = False, share_bytes: int = SHARE_BYTES,
) -> Iterator[tuple]:
    """Entries of a folder, or of one share of its names, as rows of ``ENTRY``; what goes wrong is a row too.

    ``shares`` of a row says into how many shares the listing of that folder is to be dealt.  With links
    followed, ``above`` are the identities (device, inode) of the folders a folder was reached through, and
    ``leads_back`` marks a folder that is one of them.
    """

    def described(entry: os.DirEntry, through: list[str]) -> tuple:
        inner, linked = entry.is_dir(follow_symlinks=follow_symlinks), entry.is_symlink()
        parts, leads_back = 1, False
        if inner:
            own = entry.stat(follow_symlinks=follow_symlinks or not linked)
            parts = -(-own.st_size // share_bytes) or 1
            leads_back = follow_symlinks and f"{own.st_dev}:{own.st_ino}" in through
        is_file = entry.is_file(follow_symlinks=follow_symlinks)
        return entry.path, entry.name, inner, linked, is_file, None, parts, through if inner else None, leads_back

    def failed(path: str, message: str) -> tuple:
        return path, None, False, False, False, message, 1, None, False

    try:
        through = list(above)
        if follow_symlinks:
            own = os.stat(folder)
            through.append(f"{own.st_dev}:{own.st_ino}")
        with os.scandir(folder) as found:
            for entry in found:
                if shares > 1 and zlib.crc32(os.fsencode(entry.name)) % shares != share:
                    continue
                try:
                    yield described(entry, through)
                except PermissionError:
                    yield failed(entry.path, f"Permission denied: {entry.path}")
                except OSError as err:
                    yield failed(entry.path, f"Error accessing {entry.path}: {err}")
    except PermissionError:
        if share == 0:
            yield failed(folder, f"Permission denied: {folder}")
    except OSError as err:
        if share == 0:
            yield failed(folder, f"OS error scanning {folder}: {err}")


def _list_folders(follow_symlinks: bool, share_bytes: int):
    """Entries of the folders, or shares of them, handed on in batches."""
    columns = [c.split()[0] for c in ENTRY.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for batch in batches:
            for folder, share, shares, above in zip(batch["path"], batch["share"], batch["shares"], batch["above"]):
                for row in folder_entries(folder, share, shares, above, follow_symlinks, share_bytes):
                    rows.append(row)
                    if len(rows) >= BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        yield pd.DataFrame(rows, columns=columns)

    return run


def _descend(options: filters.ScanOptions, below_checkpoint: Column) -> Column:
    """Folders whose content the next level lists.

    Checkpoint folders are entered whatever lies in them, because their size and hash need
    all files; other folders only if the scan reaches them.
    """
    reached = filters.reached(F.concat("relpath", F.lit("/.")), filters.ScanOptions(include_hidden=True))
    if not options.include_hidden:
        reached = reached & ~F.col("relpath").rlike(filters.HIDDEN_SEGMENT)
    if options.max_depth is not None:
        reached = reached & (paths.depth(F.col("relpath")) + 1 <= options.max_depth)
    inside = below_checkpoint & filters.reached(F.col("checkpoint"), options) & ~F.col("is_symlink")
    outside = ~below_checkpoint & reached
    if not options.follow_symlinks:
        outside = outside & ~F.col("is_symlink")
    return F.col("is_directory") & (inside | outside)


def list_tree(
    spark: SparkSession, root: str, options: filters.ScanOptions = filters.ScanOptions(), tasks: int | None = None,
    share_bytes: int = SHARE_BYTES,
) -> DataFrame:
    """All entries below ``root`` the scan may need, with errors as rows of their own.

    With ``follow_symlinks`` a linked folder is entered wherever a link stands, unless it is one of the folders it was
    reached through (by device and inode), so link cycles end and nothing else is left out.  A folder whose own
    size says that it has very many entries is listed by several tasks, each keeping its share of the names; so is the root.
    """
    tasks = tasks or spark.sparkContext.defaultParallelism * 4
    table = work_dir(spark, "listing")
    root = root.rstrip("/") or "/"
    frontier = spark.createDataFrame([(root, tasks, [])], "path string, shares int, above array<string>")
    level = 0
    while True:
        dealt = frontier.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        entries = dealt.repartition(tasks, F.xxhash64("path", "share")).mapInPandas(
            _list_folders(options.follow_symlinks, share_bytes), ENTRY
        )
        placed = entries.withColumn("relpath", paths.relative(F.col("path"), F.lit(root)))
        checkpoint = filters.checkpoint_folder(F.col("relpath"), F.col("is_directory"))
        placed = placed.withColumn("checkpoint", F.when(F.col("error").isNull(), checkpoint))
        descend = _descend(options, F.col("checkpoint").isNotNull()) & ~F.col("leads_back")
        placed = placed.withColumn("descend", F.coalesce(descend, F.lit(False)) & F.col("error").isNull())
        placed.write.mode("overwrite").parquet(f"{table}/level={level}")
        frontier = spark.read.parquet(f"{table}/level={level}").filter("descend")
        if frontier.isEmpty():
            break
        frontier = frontier.select("path", "shares", "above")
        level += 1
    return (
        spark.read.option("basePath", table)
        .parquet(table)
        .drop("relpath", "checkpoint", "descend", "level", "shares", "above", "leads_back")
        .withColumn("scan_path", F.lit(root))
    )


def _stat_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Size and time of the entry itself, and what a link points to."""
    for batch in batches:
        rows = []
        for path in batch["path"]:
            try:
                own = os.lstat(path)
            except OSError as err:
                kind = "Permission denied" if isinstance(err, PermissionError) else "Error accessing"
                rows.append((None, None, None, None, f"{kind}: {path}"))
                continue
            try:
                target = os.stat(path) if stat.S_ISLNK(own.st_mode) else own
            except OSError:
                rows.append((own.st_size, 0, own.st_mtime, None, None))
                continue
            rows.append((own.st_size, target.st_size, own.st_mtime, stat.S_ISDIR(target.st_mode), None))
        columns = ["size_bytes", "total_bytes", "modified_timestamp", "target_is_directory", "stat_error"]
        stats = pd.DataFrame(rows, columns=columns, index=batch.index)
        for column in ("size_bytes", "total_bytes"):
            stats[column] = stats[column].astype("Int64")
        yield pd.concat([batch, stats], axis=1)


def add_stat(entries: DataFrame) -> DataFrame:
    """Size and time, read in parallel over entries; ``target_is_directory`` is NULL for a broken link."""
    schema = f"{_ddl(entries)}, {STAT}"
    return entries.mapInPandas(_stat_rows, schema)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _read_chunks(chunk: int, overlap: int):
    """Chunks of byte ranges of files, each with the beginning of the next; unreadable files have none.

    Text drops bytes that are no UTF-8, also the rest of a character that a chunk's edge cuts: the
    chunk beside it has that character whole.
    """

    def parts(path: str, start: int, end: int | None) -> Iterator[tuple[int, bytes]]:
        try:
            with open(path, "rb") as fh:
                at = start
                while end is None or at < end:
                    fh.seek(at)
                    raw = fh.read(chunk + overlap)
                    if raw or at == 0:
                        yield at, raw
                    if len(raw) < chunk + overlap:
                        return  # this was the file's end
                    at += chunk
        except OSError:
            return

    def decoded(raw: bytes) -> str:
        return raw.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for path, wants_text, wants_bytes, start, end in batch.itertuples(index=False, name=None):
                for at, raw in parts(path, start, None if pd.isna(end) else int(end)):
                    rows.append((path, at, decoded(raw) if wants_text else None, raw if wants_bytes else None))
                    held += len(raw)
                    if held >= BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=["path", "start", "text", "raw"])
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=["path", "start", "text", "raw"])

    return run


def content_facts(
    files: DataFrame, rules: R.Rules, tasks: int, span: int = RANGE_BYTES, chunk: int = contents.CHUNK, overlap: int = contents.OVERLAP
) -> DataFrame:
    """What the content rules find in each file, read whole in chunks: ``path`` and ``contents.FACTS``.

    ``files`` has path, total_bytes, needs_text and needs_bytes; files that need neither are not opened.
    A long file is cut into ranges that different tasks read, so neither memory nor time of
    a task grows with it.  Rules that look at a file's head only have its first chunk read.
    """
    window = rules.window
    limits = [window.keyword_chars, window.yaml_chars, window.secret_chars, window.database_bytes]
    wanted = files.filter("needs_text OR needs_bytes").select("path", "total_bytes", "needs_text", "needs_bytes")
    if None in limits:
        last = (F.greatest(F.coalesce("total_bytes", F.lit(0)) - 1, F.lit(0)) / span).cast("int")
        number = F.explode(F.sequence(F.lit(0), last))
        ranges = wanted.select("*", number.alias("n"), last.alias("last")).select(
            "path", "needs_text", "needs_bytes", (F.col("n") * F.lit(span).cast("long")).alias("start"),
            F.when(F.col("n") < F.col("last"), (F.col("n") + 1) * F.lit(span).cast("long")).alias("end"),
        )
    else:
        chunk, overlap = max(4 * max(limits[:3]), limits[3]), 0  # a character has at most four bytes
        ranges = wanted.select(
            "path", "needs_text", "needs_bytes", F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("end")
        )
    ranges = ranges.repartition(tasks, F.xxhash64("path", "start"))
    chunks = ranges.mapInPandas(_read_chunks(chunk, overlap), "path string, start long, text string, raw binary")
    return contents.facts(chunks, ["path"], rules)


def _content_needs(files: DataFrame, rules: R.Rules) -> DataFrame:
    """Mark files to open, from a first classification by name and extension alone."""
    blind = files.withColumns({"head": F.lit(None).cast("string"), "head_bytes": F.lit(None).cast("binary")})
    first = C.classify(blind, rules, keep_unclassified=True)
    ext = paths.extension(F.col("filename"))
    ambiguous = ext.isin(*rules.ambiguous) if rules.ambiguous else F.lit(False)
    undecided = F.col("rule").isNull()
    raw = undecided & ambiguous & ext.isin(".bin", ".db", ".sqlite", ".sqlite3")
    words = undecided & ext.isin(".yaml", ".yml", ".json", ".txt")
    scan = (F.col("risk_level") != "danger") & ~F.arrays_overlap(
        "categories", text.strings(R.NOT_SCANNED_FOR_SECRETS)
    )
    marked = first.withColumns(
        {
            "needs_bytes": F.coalesce(raw, F.lit(False)),
            "needs_text": F.coalesce(words, F.lit(False)) | F.coalesce(scan, F.lit(False))
            | F.coalesce(raw, F.lit(False)),
        }
    )
    return marked.select(*files.columns, "needs_text", "needs_bytes")


@F.pandas_udf(T.StringType())
def file_hash(path: pd.Series) -> pd.Series:
    """SHA-256 of file bytes, streamed in chunks; NULL for unreadable files."""

    def chunks(name: str) -> Iterator[bytes]:
        with open(name, "rb") as fh:
            while chunk := fh.read(CHUNK_BYTES):
                yield chunk

    def digest(name: str) -> str | None:
        try:
            return hashing.bytes_hash(chunks(name))
        except OSError:
            return None

    return path.map(digest)


@F.pandas_udf(ACCESS)
def file_access(path: pd.Series) -> pd.DataFrame:
    """Mode, owner and group of what a path points to; NULL if it points nowhere."""

    def named(get, attribute: str, ident: int) -> str:
        try:
            return getattr(get(ident), attribute)
        except KeyError:
            return str(ident)

    def access(name: str) -> tuple:
        try:
            found = os.stat(name)
        except OSError:
            return None, None, None
        if pwd is None:
            return found.st_mode, str(found.st_uid), str(found.st_gid)
        return found.st_mode, named(pwd.getpwuid, "pw_name", found.st_uid), named(grp.getgrgid, "gr_name", found.st_gid)

    rows = pd.DataFrame([access(p) for p in path], columns=["mode", "owner", "group"])
    rows["mode"] = rows["mode"].astype("Int64")
    return rows


def add_file_hashes(files: DataFrame) -> DataFrame:
    """``hash`` of each file.  A file is opened only if the column is used."""
    return files.withColumn("hash", file_hash("path"))


def add_access(files: DataFrame) -> DataFrame:
    """``mode``, ``owner`` and ``group`` of each entry, looked up only if one of them is used."""
    found = files.withColumn("_access", file_access("path"))
    return found.withColumns({c: F.col("_access")[c] for c in ("mode", "owner", "group")}).drop("_access")


KEYS = ["machine_id", "scan_path"]


def scan(
    spark: SparkSession,
    root: str,
    options: filters.ScanOptions = filters.ScanOptions(),
    rules: R.Rules | None = None,
    machine_id: str = "local",
    tasks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Classified inventory of a tree, and the errors met as ``(path, error)``.

    Content rules see whole files, chunk by chunk, unless ``rules`` has a window (``FILE_HEADS``).  With ``compute_hashes`` and
    ``compute_permissions`` the inventory has those columns, and a query that does not use them opens no file for them.  The listing with its metadata is written once and read by all later passes.  Size and
    category filters come before hashing, which does not change the result.
    """
    rules = rules or R.Rules()
    tasks = tasks or spark.sparkContext.defaultParallelism * 4
    listed = list_tree(spark, root, options, tasks)
    table = work_dir(spark, "inventory")
    entries = listed.filter("error IS NULL").repartition(tasks, F.xxhash64("path"))
    add_stat(entries.drop("error")).withColumn("machine_id", F.lit(machine_id)).write.parquet(table)
    stored = spark.read.parquet(table)
    errors = listed.filter("error IS NOT NULL").select("path", "error").unionByName(
        stored.filter("stat_error IS NOT NULL").select("path", F.col("stat_error").alias("error"))
    )
    readable = stored.filter("stat_error IS NULL").drop("stat_error")
    walked = filters.walk(readable, options)

    files = filters.plain_files(walked).filter("is_file")
    files = filters.at_least(files, options.min_size_bytes).drop("checkpoint", "is_file")
    marked = _content_needs(files, rules)
    known = lookup_join(marked, content_facts(marked, rules, tasks), ["path"], "left")
    siblings = readable.filter(~F.col("is_directory")).select("machine_id", "path", "filename")
    classified = C.classify(known, rules, siblings, tests=contents.tests())
    classified = flag_embedded_secrets(classified, rules, F.col("secret_text")).drop(
        *contents.FACTS, "needs_text", "needs_bytes", "is_symlink", "total_bytes", "target_is_directory"
    )
    found = filters.in_categories(classified, list(options.categories))
    if options.compute_hashes:
        found = add_file_hashes(found)

    below = walked.filter("checkpoint IS NOT NULL").withColumn(
        "size_bytes", F.coalesce("total_bytes", "size_bytes")
    )
    # Broken links inside a checkpoint folder have no size; links to folders count neither.
    below = below.filter(F.col("is_directory") | ~F.col("target_is_directory"))
    folders = C.checkpoint_rows(filters.collapse_checkpoints(below, KEYS))
    folders = folders.withColumn("relpath", F.col("checkpoint"))
    folders = filters.passing(folders, options)
    if options.compute_hashes:
        folders = _with_folder_hashes(folders, below)
    inventory = found.unionByName(folders.drop("checkpoint", "n_files"), allowMissingColumns=True)
    if options.compute_permissions:
        inventory = permissions.add_permission_alerts(permissions.add_permissions(add_access(inventory)))
    return inventory.drop("rule"), errors


def _with_folder_hashes(folders: DataFrame, below: DataFrame) -> DataFrame:
    inside = below.filter(~F.col("is_directory"))
    rel = F.substr(F.col("relpath"), F.length("checkpoint") + 2)
    hashed = add_file_hashes(inside.select(*KEYS, "checkpoint", "path", rel.alias("rel")))
    digests = hashing.folder_hashes(hashed, [*KEYS, "checkpoint"])
    # one row each already; said as a grouping, Spark leaves the join out where the hash is not used
    digests = digests.groupBy(*KEYS, "checkpoint").agg(F.first("folder_hash").alias("folder_hash"))
    empty = F.sha2(F.lit(""), 256)
    return (
        folders.join(digests, [*KEYS, "checkpoint"], "left")
        .withColumn("hash", F.coalesce("folder_hash", empty))
        .drop("folder_hash")
    )
