"""Files whose layout drifts, read into one table, with a report of each change.

Rescue-column ingestion: ``ingest`` enforces the target schema on every data line; a cell under a header that
is none of the schema's, or that does not cast, is kept in ``_rescued`` with its place and header.
``approved_fields`` decides, from what was rescued, which header of a file is which field: by ``ALIASES``
(compared without case and punctuation) or by what its cells hold. ``promote`` replays the rescued cells of
those headers into the typed columns, and the changes are read off the approved fields of successive files.

Only per-file facts (a header, the counts of a column's cells) are gathered; lines stay distributed. A file's
first line that is no metadata is found by its number, a sum of partial minima, before its text is fetched.

Defined results
---------------
* metadata lines (``#key;value``), blank lines, repeated lines of a file and byte-order marks are no data; of
  repeated lines the first stays;
* a cell missing at the end of a line, empty or blank is null; a file without header gives no rows;
* the delimiter is that of ``;`` ``,`` tab and ``|`` which the header holds most of;
* null lines and null file ids are dropped; an empty table gives no rows and no changes;
* of two columns of a file that claim one field the exact name wins, then the leftmost; of two rescued cells
  of a line under one name the leftmost is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import small_side

TARGET = {"datetime": "string", "value": "double", "quality_code": "int", "quality_ok": "boolean"}

# Approved headers of the two quality fields, the codes in use and the words for them.
ALIASES = {
    "quality_code": ["qualitycode", "qc", "qcode", "qflag", "grade", "codequal", "qualcode", "flag", "code"],
    "quality_ok": ["qualityok", "ok", "valid", "usableyn", "passed", "isgood", "usable", "good", "pass", "isvalid", "isok"],
}
CODES = ["254", "31", "32", "42", "99", "101", "-1"]
CODE_WORDS = {"good": 254, "fair": 31, "estimated": 32, "poor": 42, "suspect": 99, "unchecked": 101, "missing": -1}
TRUE_WORDS, FALSE_WORDS = ["true", "1", "1.0", "y", "yes", "pass", "ok", "t"], ["false", "0", "0.0", "n", "no", "fail", "bad", "f"]
GOOD_CODE = 254
BOM = "\ufeff"
WHOLE = r"^[+-]?\d+$"
#: Share of a column's non-empty cells that must read like a field to be taken for it under an unknown header.
CONTENT_SHARE = 0.9


def plain_name(c: Column) -> Column:
    """A header without case, blanks, hyphens and underscores."""
    return F.regexp_replace(F.lower(c), r"[\s_\-]+", "")


def split_files(lines: DataFrame, distinct: bool = False) -> tuple[DataFrame, DataFrame]:
    """Headers (file_id, headers, delimiter, place of each target field) and data lines of landed text files.

    distinct: whether repeated lines of a file count once; the first stays, by partial aggregation.
    """
    clean = F.rtrim(F.ltrim("line", F.lit(BOM)), F.lit("\r\n "))
    text = lines.filter(F.col("file_id").isNotNull() & F.col("line").isNotNull()).select(
        "file_id", "line_no", clean.alias("text")
    ).filter((F.trim("text") != "") & ~F.col("text").startswith("#"))
    first = small_side(text.groupBy("file_id").agg(F.min("line_no").alias("head_no")))
    heads = text.join(first, "file_id").filter(F.col("line_no") == F.col("head_no")).groupBy("file_id", "head_no").agg(F.min("text").alias("head"))
    count = lambda d: F.length("head") - F.length(F.replace("head", F.lit(d)))
    most = F.greatest(*[count(d) for d in DELIMITERS])
    mark = F.coalesce(*[F.when(count(d) == most, d) for d in DELIMITERS])
    headers = F.transform(_split("head", mark), lambda x: F.trim(x))
    place = lambda f: (F.array_position(F.transform("headers", plain_name), f.replace("_", "")) - 1).cast("int").alias(f)
    heads = heads.select("file_id", "head", "head_no", mark.alias("delimiter"), headers.alias("headers"))
    heads = small_side(heads.withColumn("at", F.struct(*[place(f) for f in TARGET])))
    if distinct:
        text = text.groupBy("file_id", "text").agg(F.min("line_no").alias("line_no"))
    data = text.join(heads, "file_id").filter((F.col("line_no") > F.col("head_no")) & (F.col("text") != F.col("head")))
    return heads, data


DELIMITERS = [";", ",", "\t", "|"]


def _split(text: str, mark: Column) -> Column:
    out = F.split(text, ",")
    for d, pattern in ((";", ";"), ("\t", "\t"), ("|", r"\|")):
        out = F.when(mark == d, F.split(text, pattern)).otherwise(out)
    return out


def ingest(data: DataFrame) -> DataFrame:
    """file_id, line_no, the target columns, and _rescued: pos, header and cell of every cell that no target column took."""
    cells = F.transform(
        "headers", lambda h, i: F.struct(i.alias("pos"), h.alias("header"), F.nullif(F.trim(F.get("parts", i)), F.lit("")).alias("cell"))
    )
    rows = data.withColumn("parts", _split("text", F.col("delimiter"))).withColumn("cells", F.filter(cells, lambda c: c["cell"].isNotNull()))
    raw = {f: F.get(F.filter("cells", _at(F.col("at")[f])), F.lit(0))["cell"] for f in TARGET}
    strict = {
        "datetime": raw["datetime"], "value": raw["value"].try_cast("double"),
        "quality_code": F.when(raw["quality_code"].rlike(WHOLE), raw["quality_code"].try_cast("int")),
        "quality_ok": F.when(F.lower(raw["quality_ok"]).isin("true", "false"), F.lower(raw["quality_ok"]) == "true"),
    }
    rows = rows.select("file_id", "line_no", "at", "cells", *[c.alias(f) for f, c in strict.items()])
    took = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.col("at")[f]) for f in TARGET]))
    return rows.withColumn("took", took).withColumn("_rescued", F.filter("cells", _not_in("took"))).drop("cells", "took")


def _at(place: Column):
    return lambda c: c["pos"] == place


def _not_in(places: str):
    return lambda c: ~F.array_contains(F.col(places), c["pos"])


def cell_kind(c: Column) -> Column:
    return (
        F.when(c.rlike(WHOLE), "whole").when(c.rlike(r"^[+-]?(\d+\.\d*|\.\d+)$"), "decimal")
        .when(F.lower(c).isin("true", "false"), "boolean").when(c.isNotNull(), "text")
    )


def code_number(c: Column) -> Column:
    """A quality code in figures, with a Q before or a decimal point behind it, or as a word."""
    figures = F.regexp_extract(c, r"(?i)^q?\s*([+-]?\d+)(?:\.0*)?$", 1).try_cast("int")
    words = F.create_map(*[F.lit(x) for kv in CODE_WORDS.items() for x in kv])
    return F.coalesce(figures, F.try_element_at(words, F.lower(c)))


def truth(c: Column) -> Column:
    return F.when(F.lower(c).isin(TRUE_WORDS), True).when(F.lower(c).isin(FALSE_WORDS), False)


def column_facts(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per file and header: what its cells look like, from what was rescued and what the quality columns took.

    Cells are counted as texts first, so that their looks are judged once a file and text.
    """
    took = [F.when(F.col(f).isNotNull(), F.struct(F.col("at")[f].alias("pos"), F.lit(f).alias("header"), F.col(f).cast("string").alias("cell"))) for f in ALIASES]
    cells = rows.select("file_id", F.inline(F.concat("_rescued", F.array_compact(F.array(*took)))))
    texts = cells.groupBy("file_id", "pos", "cell").agg(F.count("*").alias("n"))
    kind, code = cell_kind(F.col("cell")), code_number(F.col("cell")).cast("string").isin(CODES)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    seen = texts.withColumns({"kind": kind, "code": code, "truth": truth(F.col("cell")).isNotNull()}).groupBy("file_id", "pos").agg(
        F.sum("n").alias("filled"), *[total(F.col("kind") == k).alias(k) for k in ("whole", "decimal", "boolean", "text")],
        total(F.col("code")).alias("codes"), total(F.col("truth")).alias("truths"),
    )
    named = heads.select("file_id", F.posexplode("headers").alias("pos", "header"))
    return named.join(seen, ["file_id", "pos"], "left")


def claim_fields(facts: DataFrame) -> DataFrame:
    """file_id, pos, header, field_name and kind of the columns that hold a quality field."""
    plain = plain_name(F.col("header"))
    by_name = F.when(plain.isin(ALIASES["quality_code"]), "quality_code").when(plain.isin(ALIASES["quality_ok"]), "quality_ok")
    share = lambda c: F.col(c) >= CONTENT_SHARE * F.col("filled")
    hint = plain.rlike("qual|qc|usab|good|valid|accept|trust|check")
    by_content = F.when(
        F.col("filled") > 0,
        F.when(share("codes") & (~share("truths") | hint), F.when(share("truths"), None).otherwise("quality_code"))
        .when(share("truths") & hint, "quality_ok"),
    )
    field = F.coalesce(by_name, F.when(~plain.isin("datetime", "value"), by_content))
    most = F.greatest("whole", "decimal", "boolean", "text")
    kind = F.when(F.coalesce("filled", F.lit(0)) > 0, F.when(F.col("text") > 0, "text").otherwise(
        F.when(F.col("boolean") == most, "boolean").when(F.col("decimal") > 0, "decimal").otherwise("whole")
    ))
    claims = facts.withColumns({"field_name": field, "kind": kind}).filter("field_name is not null")
    rank = F.row_number().over(
        Window.partitionBy("file_id", "field_name").orderBy(
            (plain != F.regexp_replace("field_name", "_", "")).cast("int"), by_name.isNull().cast("int"), "pos"
        )
    )
    return claims.withColumn("rank", rank).filter("rank = 1").select("file_id", "pos", "header", "field_name", "kind")


def _named(field: str):
    return lambda change: F.struct(F.lit(field).alias("field_name"), change.alias("change"))


def approved_fields(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """file_id, pos, header, field_name and kind of the headers that are a quality field; a row a file and field."""
    return claim_fields(column_facts(heads, rows))


def promote(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """Replays the rescued cells of approved headers into the typed columns; what still fits nowhere stays rescued, as JSON."""
    fields = list(ALIASES)
    wide = small_side(claims.groupBy("file_id").agg(*[F.max(F.when(F.col("field_name") == f, F.col("pos"))).alias(f"of_{f}") for f in fields]))
    rows = rows.join(wide, "file_id", "left")
    cell = {f: F.get(F.filter("_rescued", _at(F.col(f"of_{f}"))), F.lit(0))["cell"] for f in fields}
    cast = {"quality_code": code_number(cell["quality_code"]), "quality_ok": truth(cell["quality_ok"])}
    rows = rows.withColumns({f"new_{f}": c for f, c in cast.items()})
    took = F.array_compact(F.array(*[F.when(F.col(f"new_{f}").isNotNull(), F.col(f"of_{f}")) for f in fields]))
    rows = rows.withColumn("took", took).withColumns({f: F.coalesce(f, f"new_{f}") for f in fields})
    name = lambda c: F.coalesce(*[F.when(c["pos"] == F.col(f"of_{f}"), f) for f in fields], F.lower(c["header"]))
    lost = F.transform(F.filter("_rescued", _not_in("took")), lambda c: F.struct(name(c).alias("key"), c["cell"].alias("cell")))
    rows = rows.withColumn("lost", lost)
    first = F.filter("lost", lambda c, i: F.array_position(F.transform("lost", lambda x: x["key"]), c["key"]) == i + 1)
    return rows.select("file_id", "line_no", *TARGET, F.when(F.size("lost") > 0, F.to_json(F.map_from_entries(first))).alias("_rescued"))


def layout_changes(lines: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, field_name and change against the preceding file of the gauge."""
    heads, data = split_files(lines)
    claims = approved_fields(heads, ingest(data))
    order = files.filter(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.max("station_ref").alias("gauge"), F.max("seq_no").alias("seq_no"))
    wide = heads.select("file_id").join(order, "file_id")
    fields = claims.groupBy("file_id").pivot("field_name", ["quality_code", "quality_ok"]).agg(
        F.first(F.struct("header", "kind"))
    )
    wide = wide.join(fields, "file_id", "left")
    w = Window.partitionBy("gauge").orderBy("seq_no", "file_id")
    rows = wide.withColumn("nth", F.row_number().over(w)).withColumns({f"was_{f}": F.lag(f).over(w) for f in ("quality_code", "quality_ok")})
    each = []
    for f in ("quality_code", "quality_ok"):
        now, was = F.col(f), F.col(f"was_{f}")
        both = now.isNotNull() & was.isNotNull()
        changes = F.array_compact(F.array(
            F.when(now.isNotNull() & was.isNull(), "added"), F.when(now.isNull() & was.isNotNull(), "removed"),
            F.when(both & (plain_name(now["header"]) != plain_name(was["header"])), "renamed"),
            F.when(both & (now["kind"] != was["kind"]), "retyped"),
        ))
        each.append(F.transform(changes, _named(f)))
    return rows.filter("nth > 1").select("file_id", F.inline(F.concat(*each)))


def consistent_table(lines: DataFrame, files: DataFrame) -> DataFrame:
    """One row per data line in the target schema, with what did not fit as JSON in _rescued (null if nothing)."""
    heads, data = split_files(lines, distinct=True)
    rows = ingest(data)
    return promote(rows, approved_fields(heads, rows))


def replay(rows: DataFrame, field: str, header: str, cast: str) -> DataFrame:
    """Reads a rescued header into a typed column, newly approved or left null; the rescued JSON stays as evidence."""
    found = F.get_json_object("_rescued", f"$['{header}']").try_cast(cast)
    return rows.withColumn(field, F.coalesce(F.col(field), found) if field in rows.columns else found)


def file_status(lines: DataFrame) -> DataFrame:
    """file_id, form (headed by #key;value lines, or plain), their number, data rows and status: ok or no_data, an error row a file."""
    _, data = split_files(lines, distinct=True)
    text = F.ltrim("line", F.lit(BOM))
    seen = lines.filter("file_id is not null and line is not null").groupBy("file_id").agg(F.count_if(text.startswith("#")).alias("n_meta"))
    rows = seen.join(data.groupBy("file_id").agg(F.count("*").alias("n_data")), "file_id", "left").withColumn("n_data", F.coalesce("n_data", F.lit(0)))
    return rows.select(
        "file_id", F.when(F.col("n_meta") > 0, "headed").otherwise("plain").alias("form"), "n_meta", "n_data", F.when(F.col("n_data") > 0, "ok").otherwise("no_data").alias("status")
    )
