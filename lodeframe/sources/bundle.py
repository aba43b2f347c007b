"""Reading unit bundles: cards, tasks, manifests, corpora with verified digests, answers and plans, into tables.

A bundle is a folder with card.toml, task.json, manifest.json, corpus/*.json and, where it is known, reference/*. Files are
found by the manifest, never by listing a folder for data; bytes are read and hashed by Spark's binary source, so corpora
of any number of units are verified in parallel. An organiser's fault is a row in a table of faults, not an abort, until
`must_be_sound` is asked.
"""

from __future__ import annotations

import tomllib
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window as W

from lodeframe.operators import alignment, citations, schema

# fixed values of the contract
MOST_BYTES, DIGEST, CORPUS_PATH = 8 * 1024 * 1024, "^[0-9a-f]{64}$", r"^corpus/([A-Za-z0-9][A-Za-z0-9._-]{0,127})\.json$"
CARD_DEFAULTS = {"interval_level": 0.90, "faithfulness_threshold": 0.80, "tau_citation": 0.5, "composite_weights": [0.7, 0.3], "interval_leg": True}
LEGACY_THRESHOLD = 0.80
TASK = "task_id string, schema_version string, family string, target struct<name:string,type:string,labels:array<string>,label_assertions:map<string,string>>, prompt string, cutoff_date string, resolution_date string, interval_level double, entities array<string>"
MANIFEST = "manifest_version string, unit_id string, files array<struct<path:string,role:string,sha256:string,bytes:bigint,shared:boolean,entity_ids:array<string>>>"
DOCUMENT = "doc_id string, doc_date string, source string, title string, text string, spans array<struct<span_id:string,start:int,end:int,text:string>>"
ANSWER = "task_id string, target_type string, entity_predictions array<struct<entity_id:string,label:string,point_forecast:double,rank:double,interval:struct<level:double,lo:double,hi:double>,claims:array<struct<doc_id:string,span_start:variant,span_end:variant,claim:string,text:string>>>>, submitted_reasons array<struct<reason_id:string,premise:string,mechanism:string,answer_implication:string>>, notes string"
OUTCOME = "unit_id string, cutoff_date string, target_type string, outcomes array<struct<entity_id:string,true_label:string,direction:string,y:double,true_value:double>>"


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """unit, path in the unit, content, length and digest of the files of all units under root that match a glob."""
    raw = spark.read.format("binaryFile").load(f"{root}/*/{pattern}")
    parts = F.split(F.col("path"), "/")
    depth = pattern.count("/") + 2
    return raw.select(F.element_at(parts, -depth).alias("unit"), F.array_join(F.slice(parts, -(depth - 1), depth - 1), "/").alias("file"), "content", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def strict_json(content: Column, schema: str) -> tuple[Column, Column]:
    """(object, fault): text that isn't a JSON object of UTF-8 is a fault; NaN and Infinity are none that JSON knows."""
    text = F.decode(content, "UTF-8")
    outside = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', '""')  # what strings hold is no number
    bare = outside.rlike(r'(?s)[:\[,]\s*-?(?:NaN|Infinity)\s*[,\]}]')
    broken = F.try_parse_json(text).isNull() | ~F.ltrim(text).startswith("{")
    return F.from_json(text, schema), F.when(bare, "non_finite").when(broken, "not_json")


CARD = "unit string, task_id string, target_type string, interval_level double, w_a double, w_c double, tau double, interval_leg boolean, fault string"


def _card(unit: str, text: str) -> tuple:
    """The row of CARD of one card. What isn't TOML, or has values of other types, is refused whole."""
    try:
        card = tomllib.loads(text)
        given = card.get("scoring", {}).get("params", {})
        p = CARD_DEFAULTS | given
        level, tau, threshold = (float(p[x]) for x in ("interval_level", "tau_citation", "faithfulness_threshold"))
        weights = [float(x) for x in p["composite_weights"]]
        tests = [
            ("level", not 0 < level < 1), ("weights", len(weights) != 2 or abs(sum(weights) - 1) > 1e-9), ("threshold", abs(threshold - LEGACY_THRESHOLD) > 1e-12),
            ("tau", not 0 <= tau < 1), ("fixed_key", bool({"penalty_k", "contradiction_bar"} & set(given))),
        ]
        return unit, card.get("task", {}).get("id"), p.get("target_type"), level, weights[0], weights[-1], tau, bool(p["interval_leg"]), next((name for name, bad in tests if bad), None)
    except (ValueError, TypeError, KeyError, IndexError, AttributeError):
        return unit, None, None, None, None, None, None, None, "not_a_card"


def read_cards(files_: DataFrame) -> DataFrame:
    """The scoring parameters of each unit's card (unit, content: TOML in UTF-8), with defaults; fault names what is refused. Cards are parsed where they are read."""

    names, arrow = [x.split()[0] for x in CARD.split(", ")], to_arrow_schema(_parse_datatype_string(CARD))

    def parse(batches):
        for batch in batches:
            rows = [_card(u, bytes(c).decode(errors="replace")) for u, c in zip(batch.column("unit").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], arrow)

    return files_.select("unit", F.col("content").cast("binary").alias("content")).mapInArrow(parse, CARD)


def cards(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """read_cards of texts at hand (unit -> TOML)."""
    return read_cards(spark.createDataFrame([(u, t.encode()) for u, t in texts.items()], "unit string, content binary"))


def manifest_entries(manifests: DataFrame) -> DataFrame:
    """The declared corpus files of manifests (unit, file, content): path, doc_id, digest, labels and fault.

    A unit's own manifest goes before that in its corpus. A null list of entities isn't an empty one.
    """
    body, broken = strict_json(F.col("content"), MANIFEST)
    rank = F.when(F.col("file") == "manifest.json", 0).otherwise(1)
    chosen = manifests.select("unit", rank.alias("rank"), body.alias("m"), broken.alias("broken")).groupBy("unit").agg(F.min_by(F.struct("m", "broken"), "rank").alias("x"))
    one = chosen.select("unit", "x.broken", F.explode_outer("x.m.files").alias("f")).filter("broken is not null or (f.role = 'corpus' and f.path <> 'corpus/manifest.json')")
    doc_id = F.regexp_extract("f.path", CORPUS_PATH, 1)
    labelled = F.coalesce(F.size("f.entity_ids") > 0, F.lit(False))
    fault = (
        F.when(F.col("broken").isNotNull(), F.col("broken"))
        .when(doc_id == "", "path")
        .when(~F.coalesce(F.col("f.sha256").rlike(DIGEST), F.lit(False)), "digest_form")
        .when(F.coalesce("f.shared", F.lit(False)) & labelled, "shared_and_labelled")
        .when(F.size(F.array_distinct("f.entity_ids")) < F.size("f.entity_ids"), "repeated_entity")
    )
    return one.select("unit", F.col("f.path").alias("file"), doc_id.alias("doc_id"), F.col("f.sha256").alias("declared"), F.coalesce("f.shared", F.lit(False)).alias("shared"), F.col("f.entity_ids").alias("entity_ids"), fault.alias("fault"))


def verified_documents(entries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Declared files joined to their bytes: the documents, each with a fault if it can't be trusted."""
    joined = entries.join(corpus.select("unit", "file", "content", "bytes", "sha256"), ["unit", "file"], "left")
    body, broken = strict_json(F.col("content"), DOCUMENT)
    joined = joined.withColumn("d", body).withColumn("broken", broken)
    date = F.when(F.col("d.doc_date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date("d.doc_date", "yyyy-MM-dd"))
    text = F.coalesce("d.text", F.array_join(F.transform("d.spans", lambda s: s["text"]), " "), F.lit(""))
    fault = (
        F.coalesce("fault", F.when(F.col("content").isNull(), "missing_file"), F.when(F.col("bytes") > MOST_BYTES, "too_large"), F.when(F.col("sha256") != F.col("declared"), "digest_mismatch"), F.col("broken"), F.when(date.isNull(), "no_date"))
    )
    seen = F.count(F.lit(1)).over(W.partitionBy("unit", "doc_id"))
    return joined.select("unit", "doc_id", date.alias("doc_date"), text.alias("text"), F.col("d.spans").alias("spans"), "shared", "entity_ids", "sha256", F.coalesce(fault, F.when(seen > 1, "repeated_doc_id")).alias("fault"))


def tasks(content: DataFrame) -> DataFrame:
    """unit and the task's columns; entities stay JSON text, in the order and form of the file."""
    body, broken = strict_json(F.col("content"), TASK)
    return content.select("unit", body.alias("t"), broken.alias("fault")).select("unit", "t.*", "fault")


def answers(content: DataFrame) -> DataFrame:
    """submission, unit and the answer's columns; fault is NO_ANSWER's or MALFORMED's cause, null for a sound one."""
    body, broken = strict_json(F.col("content"), ANSWER)
    return content.select("unit", body.alias("a"), F.when(F.col("content").isNull(), "no_answer").otherwise(broken).alias("fault")).select("unit", "a.*", "fault")


def outcomes(content: DataFrame) -> DataFrame:
    """unit_id, entity_id, true_label and y; the older names direction and true_value are read too."""
    body, _ = strict_json(F.col("content"), OUTCOME)
    return content.select(body.alias("o")).select("o.unit_id", F.explode("o.outcomes").alias("x")).select("unit_id", "x.entity_id", F.coalesce("x.true_label", "x.direction").alias("true_label"), F.coalesce("x.y", "x.true_value").alias("y"))


def plan_lookup(units: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units with their plan entry, and the handles that the plan doesn't know; counts must equal the ids they announce."""
    joined = units.join(plan, "unit_handle", "left")
    fault = F.when(F.col("entity_ids").isNull(), "unknown_handle").when(F.col("count") != F.size("entity_ids"), "count_mismatch").when(F.size(F.array_distinct("entity_ids")) < F.size("entity_ids"), "repeated_entity")
    checked = joined.withColumn("fault", fault)
    return checked.filter("fault is null").drop("fault"), checked.filter("fault is not null").select("unit_handle", "fault")


def tree_digest(listing: DataFrame) -> DataFrame:
    """One digest of a tree of files (root, file, sha256): of the canonical JSON of its sorted paths and digests."""
    line = F.concat(F.lit('"'), F.col("file"), F.lit('":"'), F.col("sha256"), F.lit('"'))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("file", line.alias("line")))), lambda x: x["line"])
    return listing.groupBy("root").agg(F.sha2(F.concat(F.lit("{"), F.array_join(ordered, ","), F.lit("}")), 256).alias("digest"), F.count(F.lit(1)).alias("files"))


def install_plan(units: DataFrame, found: DataFrame) -> DataFrame:
    """What to do with each unit's reference answer: exactly one must be found; equal bytes are present already."""
    each = found.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.first("sha256").alias("new"))
    return units.join(each, "unit", "left").select("unit", F.when(F.coalesce("n", F.lit(0)) != 1, "refuse").when(F.col("sha256").isNull(), "copy").when(F.col("sha256") == F.col("new"), "present").otherwise("differs").alias("action"))


def must_be_sound(df: DataFrame) -> DataFrame:
    """df, or an error that names the first fault, raised by the job that reads it."""
    return df.withColumn("fault", F.when(F.col("fault").isNotNull(), F.raise_error(F.concat(F.lit("organiser's fault: "), F.col("fault")))))


# ---- whole bundles -----------------------------------------------------------------------------------------------------------
NAIVE, TASK_TABLE_LINE = "reference/naive_answer.json", "line"


def unit_folders(spark: SparkSession, root: str) -> DataFrame:
    """unit of each folder under root that holds a corpus manifest or one of its own; what has neither is no unit."""
    found = [files(spark, root, pattern).select("unit") for pattern in ("manifest.json", "corpus/manifest.json") if _any(spark, f"{root}/*/{pattern}")]
    return reduce(lambda a, b: a.union(b), found).distinct() if found else spark.createDataFrame([], "unit string")


def _any(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """files(), or no row where no unit has such a file."""
    if _any(spark, f"{root}/*/{pattern}"):
        return files(spark, root, pattern)
    return spark.createDataFrame([], "unit string, file string, content binary, bytes long, sha256 string")


def task_roster(task: DataFrame) -> DataFrame:
    """unit, pos, entity_id, name and line of each entity of tasks (unit, entities: JSON texts), the line being the entity's row in the task's table."""
    text = F.col("entity")
    return task.select("unit", F.posexplode("entities").alias("pos", "entity")).select("unit", "pos", F.get_json_object(text, "$.entity_id").alias("entity_id"), F.get_json_object(text, "$.name").alias("name"), _spaced(text).alias(TASK_TABLE_LINE))


def _spaced(text: Column) -> Column:
    """JSON text with ", " and ": " between its parts, as the task's table is written; strings stay as they are."""
    token = r'"(?:[^"\\]|\\.)*"|[,:]|[^",:]+'
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(token), F.lit(0)), lambda t: F.when(t.isin(",", ":"), F.concat(t, F.lit(" "))).otherwise(F.when(t.startswith('"'), t).otherwise(F.trim(t)))), "")


def answer_rows(read: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(predictions, claims) of answers (keys and the columns of ANSWER), in the order of the file; only the first claims of an entity count."""
    rows = read.filter("fault is null").select(*keys, F.explode("entity_predictions").alias("p"))
    predictions = rows.select(*keys, "p.entity_id", "p.label", F.col("p.point_forecast").alias("point"), F.col("p.interval.lo").alias("low"), F.col("p.interval.hi").alias("high"), F.col("p.interval.level").alias("level"), F.col("p.claims").alias("claims"))
    each = alignment.explode_claims(predictions, keys)
    whole = lambda name: alignment.whole_offset(F.to_json(name))
    claims = each.select(*keys, "entity_id", "claim_pos", "doc_id", whole("span_start")[0].alias("span_start"), whole("span_end")[0].alias("span_end"), (whole("span_start")[1] | whole("span_end")[1]).alias("bad_offsets"), F.coalesce("claim", "text").alias("claim"))
    return predictions.drop("claims"), claims


def hydrate(spark: SparkSession, root: str, submissions: str | None = None) -> dict[str, DataFrame]:
    """The tables of an evaluation from the unit folders under root, and `faults`: what of the organiser's material can't be trusted.

    Answers are read from submissions/<unit>/<submission>.json. A naive answer has to be there, and to cover the roster, where there is an outcome.
    """
    return _hydrated(lambda pattern: _files(spark, root, pattern), unit_folders(spark, root), _files(spark, submissions or f"{root}-answers", "*.json"))


def hydrate_files(given: DataFrame, submitted: DataFrame) -> dict[str, DataFrame]:
    """hydrate() of files as rows (unit, file, content), from whatever source Spark reads them: those of units, and those of answers."""
    text = F.col("content").cast("binary")
    sized = lambda df: df.select("unit", "file", text.alias("content"), F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("sha256"))
    pick = lambda pattern: sized(given).filter(F.col("file").rlike("^" + pattern.replace(".", "[.]").replace("*", "[^/]*") + "$"))
    units = pick("manifest.json").union(pick("corpus/manifest.json")).select("unit").distinct()
    return _hydrated(pick, units, sized(submitted))


def _hydrated(pick: Callable[[str], DataFrame], units: DataFrame, submitted: DataFrame) -> dict[str, DataFrame]:
    """The tables of hydrate(): pick gives the files that match a glob."""
    tasks_ = tasks(pick("task.json").select("unit", "content")).join(units, "unit", "left_semi")
    card = read_cards(pick("card.toml").join(units, "unit", "left_semi"))
    target = F.coalesce("target_type", "target.type")
    made = tasks_.withColumnRenamed("fault", "task_fault").join(card.select("unit", F.col("target_type"), F.col("interval_level").alias("level"), "w_a", "w_c", "interval_leg", F.col("fault").alias("card_fault")), "unit")
    cutoff = citations.iso_date(F.col("cutoff_date"))
    unit_table = made.select(F.col("unit").alias("unit_id"), target.alias("target_type"), cutoff.alias("cutoff"), F.col("target.labels").alias("labels"), "level", "w_a", "w_c", "interval_leg", "task_id")
    roster = task_roster(tasks_).withColumnRenamed("unit", "unit_id")
    manifests = pick("manifest.json").select("unit", "file", "content").union(pick("corpus/manifest.json").select("unit", "file", "content"))
    docs = verified_documents(manifest_entries(manifests), pick("corpus/*.json"))
    outcome = outcomes(pick("reference/outcome.json"))
    rule = answers(pick(NAIVE).select("unit", "content")).withColumnRenamed("unit", "unit_id")
    naive, _ = answer_rows(rule, ["unit_id"])
    read = _submissions(submitted)
    predictions, claims = answer_rows(read, ["submission_id", "unit_id"])
    bad = claims.filter("bad_offsets").select("submission_id", "unit_id", F.lit("bad_offsets").alias("bad")).distinct()
    answer_table = read.join(bad, ["submission_id", "unit_id"], "left").select("submission_id", "unit_id", F.coalesce("fault", "bad", F.when(F.col("schema_faults") > 0, "schema")).alias("fault"), "task_id")
    covered = alignment.roster_check(roster.join(outcome.select("unit_id").distinct(), "unit_id", "left_semi").select("unit_id", "entity_id"), naive.select("unit_id", "entity_id"), ["unit_id"])
    faults = reduce(
        lambda a, b: a.unionByName(b),
        [
            made.select(F.col("unit").alias("unit_id"), F.lit("task.json").alias("file"), F.coalesce("task_fault", F.when(cutoff.isNull(), "no_cutoff")).alias("fault")),
            made.select(F.col("unit").alias("unit_id"), F.lit("card.toml").alias("file"), F.col("card_fault").alias("fault")),
            units.join(made.select("unit"), "unit", "left_anti").select(F.col("unit").alias("unit_id"), F.lit("task.json").alias("file"), F.lit("missing_file").alias("fault")),
            alignment.roster_faults(roster, ["unit_id"]).select("unit_id", F.lit("task.json").alias("file"), F.lit("roster").alias("fault")),
            docs.select(F.col("unit").alias("unit_id"), F.col("doc_id").alias("file"), "fault"),
            rule.select("unit_id", F.lit(NAIVE).alias("file"), "fault"),
            covered.filter("reason <> 'unknown'").select("unit_id", F.lit(NAIVE).alias("file"), F.concat(F.lit("roster_"), "reason").alias("fault")),
        ],
    ).filter("fault is not null")
    sound = docs.filter("fault is null").select(F.col("unit").alias("unit_id"), "doc_id", "doc_date", "text", "shared", "entity_ids")
    return {
        "units": unit_table, "roster": roster, "answers": answer_table, "predictions": predictions, "claims": claims.drop("bad_offsets"), "docs": sound,
        "truth": outcome.select("unit_id", "entity_id", "true_label", "y"), "naive": naive.select("unit_id", "entity_id", "label", "point", "low", "high"), "faults": faults,
    }


def _submissions(submitted: DataFrame) -> DataFrame:
    """submission_id, unit_id, the answer's columns, schema_faults and fault of files <unit>/<submission>.json."""
    found = submitted.select(F.col("unit").alias("unit_id"), F.regexp_extract("file", r"([^/]+)\.json$", 1).alias("submission_id"), "content")
    body, broken = strict_json(F.col("content"), ANSWER)
    gate = F.size(schema.schema_faults(F.decode("content", "UTF-8"), schema.answer_schema()))
    rows = found.select("submission_id", "unit_id", body.alias("a"), gate.alias("schema_faults"), broken.alias("fault"))
    return rows.select("submission_id", "unit_id", "a.*", "schema_faults", "fault")


def self_check(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """The claims of one's own answer (unit_id, entity_id, doc_id, span_start, span_end) that don't resolve to a piece of their document."""
    joined = claims.join(docs.select("unit_id", "doc_id", "text"), ["unit_id", "doc_id"], "left")
    start, end = F.col("span_start"), F.col("span_end")
    sound = (start >= 0) & (start < end) & (end <= F.length("text"))
    return joined.filter(~F.coalesce(sound, F.lit(False))).select("unit_id", "entity_id", "doc_id", "span_start", "span_end", F.when(F.col("text").isNull(), "unknown_doc").otherwise("bad_span").alias("code"))
