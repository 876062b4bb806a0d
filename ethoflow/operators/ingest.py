"""From plate records and video metadata to rows of the experiment database."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ethoflow.functions.text import compact, is_gradient, joined_label, parsed_date, wells
from ethoflow.operators.metadata import matched_videos, with_candidates

#: Parts of a sheet's headings (in lower case) and the field each stands for; the first column that fits counts.
HEADINGS = (
    ("key", "key"),
    ("initials", "initials"),
    ("date of fertilisation", "fert_date"),
    ("female tank", "female_tank"),
    ("female identifier", "female_identifier"),
    ("background strain", "background_strain"),
    ("neurod2", "target_gene"),
    ("cas9", "cas9"),
    ("sgrna", "sgrna"),
    ("sequence folder", "seq_folder"),
    ("date of experiment", "exp_date"),
    ("stage of tadpole", "stage"),
    ("control arenas", "control_arenas"),
    ("test arenas", "test_arenas"),
    ("drug and dose", "drug_dose"),
    ("notes", "notes"),
)
#: The fields that hold dates are kept as written; ``parsed_date`` reads them.
RAW = {"fert_date": "fert_date_raw", "exp_date": "exp_date_raw"}


def sheet_records(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Plate records of a metadata sheet, a workbook or saved as CSV: one row a plate, absent fields empty, and its videos as an array.

    The second line holds the headings. Lines without a key are left out; columns whose heading begins with ``video``
    name recordings.
    """
    if path.endswith(".xlsx"):
        from ethoflow.sources import sheets

        return plate_records(sheets.rows(spark, path, sheet))
    raw = spark.read.csv(path, header=False, multiLine=True, escape='"')
    line = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.monotonically_increasing_id()))  # one small file
    return plate_records(raw.select(line.alias("line"), F.array(*raw.columns).alias("cells")))


def plate_records(lines: DataFrame) -> DataFrame:
    """``sheet_records`` of rows (line, cells), lines from 1."""
    head = {r.line: r.cells for r in lines.where("line <= 2").collect()}
    if 2 not in head:
        raise ValueError("the sheet has no headings")
    labels = [str(x or "").strip().lower() for x in head[2]]
    at: dict[str, int] = {}
    for column, label in enumerate(labels):
        for part, name in HEADINGS:
            if label and part in label and name not in at:
                at[name] = column
    if "key" not in at:
        raise ValueError("the sheet has no key column")
    cell = lambda i: F.trim(F.coalesce(F.get("cells", F.lit(i)), F.lit("")))
    rows = lines.where((F.col("line") > 2) & (cell(at["key"]) != ""))
    fields = [(cell(at[n]) if n in at else F.lit("")).alias(RAW.get(n, n)) for n in dict(HEADINGS).values()]
    videos = [cell(i) for i, label in enumerate(labels) if label.startswith("video")]
    named = F.filter(F.array(*videos), lambda v: v != "") if videos else F.array().cast("array<string>")
    return rows.select(*fields, named.alias("videos"))


def with_derived(plates: DataFrame) -> DataFrame:
    """Plate records with transgene, arena role, gradient flag and occupied wells.

    Control arenas are the occupied ones if there are any, else the test arenas.
    """
    control, test = wells(F.col("control_arenas")), wells(F.col("test_arenas"))
    return plates.withColumns({
        "transgene": joined_label(("target_gene", "sgrna")), "arena_role": F.when(F.size(control) > 0, "control").otherwise("test"),
        "is_gradient": is_gradient(F.col("test_arenas")) | is_gradient(F.col("drug_dose")),
        "occupied": F.when(F.size(control) > 0, control).otherwise(test),
    })


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


#: Columns that a plan takes over from a plate's record.
CARRIED = ("female_identifier", "background_strain", "female_tank", "target_gene", "sgrna", "seq_folder")


def build_plan(videos: DataFrame, plates: DataFrame) -> DataFrame:
    """One row a video (column filename) with its plate's fields, ready for review; without a plate, notes name the candidates."""
    found = with_candidates(matched_videos(videos, plates), plates, F.col("key").isNull())
    rows = found.join(with_derived(plates), "key", "left")
    known = F.col("key").isNotNull()
    choose = F.concat(F.lit("NEEDS MANUAL MATCH"), F.when(F.size("keys") > 0, F.concat(F.lit("; candidates: "), F.array_join("keys", ", "))).otherwise(""))
    fields = {
        "video_stem": F.regexp_replace("filename", r"\.[^.]*$", ""), "row_key": _text(F.col("key")), "match_method": F.col("status"),
        "investigator_initials": _text(F.col("initials")), **{c: _text(F.col(c)) for c in CARRIED},
        "transgene": F.when(known, F.col("transgene")).otherwise(""), "fert_date": _text(parsed_date(F.col("fert_date_raw"))),
        "fert_date_raw": _text(F.col("fert_date_raw")), "exp_date": _text(parsed_date(F.col("exp_date_raw"))),
        "occupied_wells": F.when(known, compact(F.col("occupied"))).otherwise(""), "n_occupied": F.when(known, F.size("occupied")).otherwise(0),
        "is_gradient": F.when(known, F.when(F.col("is_gradient"), "1").otherwise("0")).otherwise(""),
        "arena_role": F.when(known, F.col("arena_role")).otherwise(""), "notes": F.when(known, _text(F.col("notes"))).otherwise(choose),
    }
    return rows.select(F.col("filename").alias("video_path"), *(x.alias(c) for c, x in fields.items()))


def plan_status(plan: DataFrame, allow_gradient: bool = False) -> DataFrame:
    """Adds what a commit will do with each row: ``ready``, or why it is skipped."""
    gradient = (F.col("is_gradient") == "1") & F.lit(not allow_gradient)
    status = (
        F.when((_text(F.col("transgene")) == "") | (_text(F.col("video_path")) == ""), "no transgene/path").when(gradient, "gradient")
        .when(F.size(wells(F.col("occupied_wells"))) == 0, "no occupied wells").otherwise("ready")
    )
    return plan.withColumn("plan_status", status)


def plan_counts(plan: DataFrame) -> DataFrame:
    """One row: videos, matched and unmatched ones, and matched ones on gradient plates."""
    matched = F.col("row_key") != ""
    return plan.agg(
        F.count(F.lit(1)).alias("n_videos"), F.count_if(matched).alias("n_matched"), F.count_if(~matched).alias("n_unmatched"),
        F.count_if(matched & (F.col("is_gradient") == "1")).alias("n_gradient"),
    )


def layouts(plan: DataFrame, ids: Mapping[str, Column]) -> DataFrame:
    """24 rows (well_number from 0) for each ready row of a plan; wells that are not occupied have no well and group.

    ids: the columns or values of investigator_id, experiment_type_id, well_type_id and tadpole_group_id.
    """
    ready = plan_status(plan).where("plan_status = 'ready'")
    grid = ready.withColumn("well_number", F.explode(F.sequence(F.lit(0), F.lit(23))))
    there = F.array_contains(wells(F.col("occupied_wells")), F.col("well_number") + 1)
    return grid.select(
        "video_stem", "well_number", ids["investigator_id"].cast("int").alias("investigator_id"), ids["experiment_type_id"].cast("int").alias("experiment_type_id"),
        F.when(there, ids["well_type_id"]).cast("int").alias("well_type_ids"), F.when(there, ids["tadpole_group_id"]).cast("int").alias("tadpole_type_ids"),
    )


def series_by_attributes(series: DataFrame, attributes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (request, series_id): the first series of the same type, investigator and date whose attributes are exactly the wanted ones.

    attributes: series_id and attribute_id; wanted: request, experiment_type_id, investigator_id, experiment_date and attribute_ids (an array).
    """
    own = attributes.groupBy("series_id").agg(F.array_sort(F.collect_set("attribute_id")).alias("own"))
    have = series.join(own, "series_id", "left").withColumn("own", F.coalesce("own", F.array().cast("array<int>")))
    asked = wanted.withColumn("asked", F.array_sort(F.array_distinct("attribute_ids")))
    # Of series that no request can tell apart only the first is met, so a request has one hit at most.
    facts = ("experiment_type_id", "investigator_id", "experiment_date")
    have = have.groupBy(*facts, "own").agg(F.min("series_id").alias("series_id"))
    same = [asked[c].eqNullSafe(have[c]) for c in facts]
    hits = asked.join(have, [*same, F.col("asked") == F.col("own")]).groupBy("request").agg(F.min("series_id").alias("series_id"))
    return wanted.select("request").join(hits, "request", "left")


def video_rows(metadata: DataFrame, series_id: Column, first_id: int = 1) -> DataFrame:
    """Rows of the video table from video metadata: numbered by time, with the pixels of a millimetre across the well."""
    w = Window.partitionBy("series").orderBy("date_time", "name")
    rows = metadata.withColumn("series", series_id).withColumn("n", F.row_number().over(w) - 1)
    size = F.count(F.lit(1)).over(Window.partitionBy("series"))
    return rows.select(
        F.col("series").alias("series_id"), (F.col("median_well_radius_pixels") * 2 / F.col("real_well_diameter_mm")).alias("pix2mm"), F.col("name").alias("filename"),
        "camera", F.col("n").cast("int").alias("video_series_num"), size.cast("int").alias("video_series_size"), "fps", "date_time",
    )


def series_start(metadata: DataFrame, keys: list[str]) -> DataFrame:
    """The earliest recording of each series, which dates it."""
    return metadata.groupBy(*keys).agg(F.min("date_time").alias("experiment_date"), F.min_by("name", F.struct("date_time", "name")).alias("first_video"))


def trial_rows(layout: DataFrame, videos: DataFrame) -> DataFrame:
    """Rows of the trial table: one an occupied well, wells counted from 1, with an id that repeated runs give again."""
    rows = layout.where("tadpole_type_ids is not null").join(videos, "video_stem")
    well = (F.col("well_number") + 1).cast("int")
    return rows.select(
        (F.col("video_id") * 32 + well).alias("trial_id"), "video_id", well.alias("well_number"), F.col("well_type_ids").alias("well_type_id"),
        F.col("tadpole_type_ids").alias("tadpole_group_id"),
    )


def occupied_tracks(trials: DataFrame, tracks: DataFrame) -> DataFrame:
    """Frames of the occupied wells of all videos at once, with their trial: tracks has video_id, well_number and frame_number."""
    return tracks.join(trials.select("trial_id", "video_id", "well_number"), ["video_id", "well_number"])
