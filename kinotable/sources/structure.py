"""What encloses each line of a layer: definitions and time-sample blocks, found once for all of them.

The block that is open at a level is the one opened last at that level, so one
walk that remembers the last opening of each level tells everything that
encloses a line.  Work is lines times levels; there is no list of what stands
before a line.  A definition, or an attribute with time samples, owns the
first opening at its level after it; its brace may stand on a later line,
after metadata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinotable.operators.prefix import running
from kinotable.plans.rounds import kept

STAGE = "<stage>"
#: A typed definition, by a pattern that the layer format sets (a fixed value).
DEFINITION = r'(?U)^\s*def\s+(\w+)\s+"([^"]+)"'
#: Lines that are sorted at once where a layer is cut.
CHUNK = 1 << 16


def file_lines(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(path, ln, line, before, depth, at) of each line of text files, of which one file may be many tasks' work.

    Lines are those between line breaks; a break at the end of a file opens no
    further line.  ``at`` is the character that a line starts with.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    # rows of a split come in the order of the file, and splits are told apart by where they start
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    rows = kept(rows)  # what follows reads them several times; files are opened once
    firsts = rows.groupBy("path", "split").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    counted = running(firsts, ["path"], "split", sums={"begin": F.col("n")}, strict=True).select("path", "split", "first", "begin")
    numbered = rows.join(counted, ["path", "split"]).select("path", (F.col("begin") + F.col("place") - F.col("first")).alias("ln"), "line")
    return measured(numbered, chunk)


def measured(split: DataFrame, chunk: int | None = None) -> DataFrame:
    """(path, ln, line, before, depth, at) of lines (path, ln, line)."""
    change = F.length(F.translate("line", "}", "")) - F.length(F.translate("line", "{", ""))
    size = F.length("line") + 1
    held = running(split, ["path"], "ln", sums={"depth": change, "end": size}, chunk=chunk)
    return held.select("path", F.col("ln").cast("long").alias("ln"), "line", (F.col("depth") - change).alias("before"), "depth", (F.col("end") - size).alias("at"))


def text_lines(layers: DataFrame, chunk: int | None = None) -> DataFrame:
    """(path, ln, line, before, depth, at) of layers (path, text)."""
    return measured(layers.select("path", F.posexplode(F.split("text", "\n")).alias("ln", "line")), chunk)


#: Characters of layers that one task takes: at most about so many, and no task is made for less than the lower number.
DEALT = (1 << 20, 1 << 22)


def dealt(layers: DataFrame, sizes: tuple[int, int] = DEALT) -> DataFrame:
    """layers (path, text) dealt by path, to so many tasks that each takes about as many characters as ``sizes`` tells; one job counts them.

    What follows by path then needs no exchange of lines, and a task's memory
    doesn't grow with the number of layers.
    """
    least, most = sizes
    count = layers.agg(F.sum(F.length("text"))).first()[0] or 0
    usual = int(layers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return layers.repartition(max(1, min(usual, -(-count // least)), -(-count // most)), "path")


def deepest(measured: DataFrame) -> int:
    """The greatest number of blocks that are open at once; one job."""
    return max(0, measured.agg(F.max(F.greatest("before", "depth"))).first()[0] or 0)


def structured(lines: DataFrame, attributes: str | None = None, levels: int | None = None, chunk: int | None = None) -> DataFrame:
    """lines with ``prims`` (names of the enclosing definitions, outermost first), ``nearest`` (the last definition at or before the line) and ``block``.

    ``block`` is the time-sample block that the line is in, of an attribute
    that matches the pattern ``attributes``: (ln, before, indent, decl, attr,
    nearest).  ``levels`` bounds the levels that are looked at; without it
    they are counted first.  A line that opens or closes a block is inside it.
    """
    line = F.col("line")
    # a look for the fixed words spares most lines the patterns
    name = F.when(F.contains(line, F.lit("def")), F.nullif(F.regexp_extract(line, DEFINITION, 2), F.lit("")))
    opening = rf"(?U)^(.*?)([ \t]*)(\w+\d*\s+)?({attributes or '(?!)'})\.timeSamples\s*="
    sample = F.contains(line, F.lit(".timeSamples")) & line.rlike(opening)
    group = lambda i: F.regexp_extract(line, opening, i)
    mark = F.when(name.isNotNull(), F.struct(F.lit("def").alias("kind"), name.alias("name"), "ln", "before", F.lit("").alias("indent"), F.lit("").alias("decl"), F.lit("").alias("attr")))
    mark = mark.when(sample, F.struct(F.lit("attr").alias("kind"), F.lit(None).cast("string").alias("name"), "ln", "before", group(2).alias("indent"), F.concat(group(3), group(4)).alias("decl"), group(4).alias("attr")))
    opens = F.col("depth") > F.col("before")
    # metadata such as ``customData = {`` is no body of a definition; what has a mark of its own is
    bare = line.rlike(r"^\s*\{") | mark.isNotNull()
    own = lines.withColumn("mark", mark)
    whole = sample & ~opens & F.contains(F.regexp_replace(line, opening, ""), F.lit("{"))  # begins and ends on its line
    event = F.when((opens & bare) | whole, F.struct(F.lit(None).cast(_MARK).alias("m"))).when(F.col("mark").isNotNull(), F.struct(F.col("mark").alias("m")))
    # an opening ends what waits at its level; a mark that doesn't open by itself waits for it
    waiting = running(own, ["path", "before"], "ln", lasts={"event": event}, chunk=chunk, strict=True)
    waiting = kept(waiting) if chunk else waiting
    waiting = running(waiting, ["path"], "ln", lasts={"nearest": name}, chunk=chunk)
    waiting = kept(waiting) if chunk else waiting
    owner = F.when(bare, F.coalesce(F.col("mark"), F.col("event.m")))
    many = deepest(lines) if levels is None else levels
    opened = {f"__{k}": F.when(opens & (F.col("before") <= k) & (F.col("depth") > k), F.struct(F.when(F.col("before") == k, owner).alias("m"))) for k in range(many)}
    found = running(waiting, ["path"], "ln", lasts=opened, chunk=chunk)
    inside = F.greatest("before", "depth")
    stack = [F.when(inside > k, F.col(f"__{k}.m")) for k in range(many)]
    names = F.filter(F.array(*[F.when(m["kind"] == "def", m["name"]) for m in stack], F.lit(None).cast("string")), lambda n: n.isNotNull())
    innermost = F.coalesce(*[F.when(inside == k + 1, m) for k, m in enumerate(stack)], F.lit(None).cast(_MARK))
    # a block may begin and end on one line; a mark whose brace comes later has its own line as well
    block = F.when(F.col("mark.kind") == "attr", F.col("mark")).when(innermost["kind"] == "attr", innermost)
    return found.select(*lines.columns, names.alias("prims"), "nearest", block.alias("block"))


_MARK = "struct<kind:string,name:string,ln:bigint,before:bigint,indent:string,decl:string,attr:string>"


def prim_path(prims: Column) -> Column:
    """``/root/a`` of the names of enclosing definitions; the stage itself is ``/``."""
    return F.concat(F.lit("/"), F.array_join(prims, "/"))


def enclosing(structure: DataFrame) -> DataFrame:
    """structure with ``prim``: the innermost definition around a line; a line that defines at the stage belongs to what it defines."""
    name = F.when(F.contains("line", F.lit("def")), F.nullif(F.regexp_extract("line", DEFINITION, 2), F.lit("")))
    return structure.withColumn("prim", F.coalesce(F.try_element_at("prims", F.lit(-1)), name, F.lit(STAGE)))
