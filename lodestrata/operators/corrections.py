"""What a reviewed correction and a screening must agree with before they are stored: faults by row, nothing is repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import variants
from lodestrata.functions.variants import at, kind_of, same_json
from lodestrata.operators.validation import faults

# Fixed values of the correction layer.
CORRECTED_SOURCE = "organized-parcels"
FIELDS = ("GEOCODE", "STATE_ID")
KINDS = {  # kind of a soil row: its own key, and the kind and key of its parent
    "legend": ("lkey", None, None),
    "mapunit": ("mukey", "legend", "lkey"),
    "component": ("cokey", "mapunit", "mukey"),
    "chorizon": ("chkey", "component", "cokey"),
    "mupolygon": ("mupolygonkey", "mapunit", "mukey"),
}


def attribute_proposal_faults(records: DataFrame, proposals: DataFrame, exceptions: DataFrame, source_id: str = CORRECTED_SOURCE, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Add ``faults`` to corrections of attributes that are to be stored.

    ``records``: object_id, source_snapshot, feature_text, proposal (JSON text, null without one), holds (array of strings);
    ``proposals`` (object_id, proposal) and ``exceptions`` (object_id, holds): what the reviewed audit says. A record is that of
    its feature, its proposal and holds are the audit's, and a proposal is of this very text, still proposed and
    inferred; each of its changes is of a field that may change, from the raw value as it is, to a text.
    Proposals are counted before they are joined; null holds are none.
    """
    audit = proposals.groupBy(F.col("object_id").alias("_id")).agg(F.count("*").alias("_many"), F.min("proposal").alias("_audit"))
    held = exceptions.groupBy(F.col("object_id").alias("_of")).agg(F.first("holds").alias("_holds"))
    joined = records.join(audit, F.col("object_id") == F.col("_id"), "left").join(held, F.col("object_id") == F.col("_of"), "left")
    none = F.expr("cast(array() as array<string>)")
    rows = joined.withColumns({"_f": variants.parsed(F.col("feature_text")), "_p": variants.parsed(F.col("proposal")), "_a": variants.parsed(F.col("_audit"))})
    p, feature = F.col("_p"), F.col("_f")
    text = lambda path: at(p, path, "string")
    there = F.col("proposal").isNotNull()
    changes = F.coalesce(F.map_entries(at(p, "$.changes", "map<string,variant>")), F.expr("cast(array() as array<struct<key:string,value:variant>>)"))

    def sound(change: Column) -> Column:
        raw = at(feature, "$.properties", "map<string,variant>")
        allowed = change["key"].isin(*fields)
        unchanged = same_json(at(change["value"], "$.from"), F.try_element_at(raw, change["key"]))
        return allowed & unchanged & (F.coalesce(kind_of(change["value"], "$.to"), F.lit("")) == "STRING")

    current = (
        (text("$.status") == "proposed") & (text("$.evidence_state") == "INFERRED") & (text("$.source_id") == source_id)
        & (text("$.source_snapshot_sha256") == F.col("source_snapshot")) & (text("$.source_feature_sha256") == F.sha2("feature_text", 256))
        & at(p, "$.holds", "array<string>").eqNullSafe(F.coalesce("holds", none)) & text("$.global_id").eqNullSafe(at(feature, "$.properties.GlobalID", "string"))
    )
    checks = faults(
        identity=at(feature, "$.properties.OBJECTID", "long") == F.col("object_id"), ambiguous=F.coalesce("_many", F.lit(0)) <= 1, proposal=same_json(p, F.col("_a")),
        scope=F.col("_many").isNotNull() | F.col("_holds").isNotNull(), holds=F.coalesce("holds", none) == F.coalesce("_holds", none), stale=~there | F.coalesce(current, F.lit(False)),
        changes=~there | ((kind_of(p, "$.changes") == "OBJECT") & (F.size(changes) > 0)), change=~there | F.forall(changes, sound),
    )
    return rows.select(*records.columns, checks.alias("faults"))


def screening_faults(zones: DataFrame, originals: DataFrame, acceptances: DataFrame, subjects: DataFrame, previous: DataFrame) -> DataFrame:
    """Faults (kind, id, fault) of what a screening is to be computed from; sound inputs have no row.

    ``zones``: object_id, raw_text, shape_text, state, event_id (what the screening would use); ``originals``: object_id,
    raw_text, shape_text, state; ``acceptances``: object_id, event_id, shape_text, state (accepted interpretations);
    ``subjects``: subject_id, raw_text; ``previous``: subject_id, raw_sha256. Zones and subjects are the same as before, none
    twice, and with unchanged sources; a zone has its own shape and state, or those of the acceptance that it names.
    """
    def membership(now: DataFrame, before: DataFrame, key: str, kind: str) -> DataFrame:
        a = now.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"))
        b = before.select(F.col(key).alias("_id")).distinct()
        both = a.join(b, F.col("id") == F.col("_id"), "full_outer")
        fault = F.when(F.col("_id").isNull(), "added").when(F.col("id").isNull(), "removed").when(F.col("n") > 1, "repeated")
        return both.select(F.lit(kind).alias("kind"), F.coalesce("id", "_id").alias("id"), fault.alias("fault"))

    o = originals.select(F.col("object_id").alias("_o"), F.col("raw_text").alias("_raw"), F.col("shape_text").alias("_shape"), F.col("state").alias("_state"))
    a = acceptances.select(F.col("object_id").alias("_a"), F.col("event_id").alias("_event"), F.col("shape_text").alias("_taken"), F.col("state").alias("_taken_state"))
    met = zones.join(o, F.col("object_id") == F.col("_o")).join(a, F.col("object_id") == F.col("_a"), "left")
    taken = F.col("_a").isNotNull()
    checks = faults(
        source=F.col("raw_text") == F.col("_raw"), acceptance=F.col("event_id").eqNullSafe(F.col("_event")),
        shape=F.col("shape_text").eqNullSafe(F.when(taken, F.col("_taken")).otherwise(F.col("_shape"))), state=F.col("state").eqNullSafe(F.when(taken, F.col("_taken_state")).otherwise(F.col("_state"))),
    )
    of_zones = met.select(F.lit("zone").alias("kind"), F.col("object_id").alias("id"), F.explode(checks).alias("fault"))
    p = previous.select(F.col("subject_id").alias("_p"), "raw_sha256")
    moved = subjects.join(p, F.col("subject_id") == F.col("_p")).filter(~F.sha2("raw_text", 256).eqNullSafe(F.col("raw_sha256")))
    of_subjects = moved.select(F.lit("subject").alias("kind"), F.col("subject_id").alias("id"), F.lit("source").alias("fault"))
    parts = [membership(zones, originals, "object_id", "zone"), of_zones, membership(subjects, previous, "subject_id", "subject"), of_subjects]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).filter("fault is not null")


def usable_references(intersections: DataFrame, zones: DataFrame) -> DataFrame:
    """Intersections (subject_id, object_id) that name a zone which is not there or not valid (must be empty)."""
    valid = zones.filter("state = 'valid'").select("object_id").distinct()
    return intersections.join(valid, "object_id", "left_anti").select("subject_id", "object_id")


def soil_rows(records: DataFrame, text: str = "input_text") -> DataFrame:
    """Decode soil rows: add kind, source_key, parent_kind, parent_key, scope_relation, hold, input_sha256 and ``faults``.

    A row names one of five kinds, and its key is the one in its raw record; the parent follows from the kind. Only a
    ``mupolygon`` has a geometry: with its CRS and scope, and either held with a reason and without a geometry, or not held with
    one. What is not JSON has the fault of its kind; the parents themselves are looked up by ``history.orphans``.
    """
    # Parsed once a row, as a column of its own: an expression is worked out wherever it is used.
    records = records.withColumn("_lodestrata_v", variants.parsed(F.col(text)))
    v = F.col("_lodestrata_v")
    value = lambda path: at(v, path, "string")
    kind = value("$.kind")
    choose = lambda make: F.coalesce(*[F.when(kind == k, make(k)) for k in KINDS])
    key_value = choose(lambda k: value(f"$.raw.{KINDS[k][0]}"))
    parent_kind = choose(lambda k: F.lit(KINDS[k][1]).cast("string"))
    parent_key = choose(lambda k: value(f"$.raw.{KINDS[k][2]}") if KINDS[k][2] else F.lit(None).cast("string"))
    scope, hold, wkb = value("$.scope_relation"), value("$.hold"), value("$.geometry_wkb")
    polygon = kind == "mupolygon"
    held = hold.isNotNull()
    checks = faults(
        kind=kind.isin(*KINDS), identity=value("$.source_key").eqNullSafe(key_value) & key_value.isNotNull(), parent=parent_kind.isNull() | parent_key.isNotNull(),
        provenance=variants.is_text(v, "$.provenance.response_sha256", r"^[0-9a-f]{64}\z") & (at(v, "$.provenance.row_ordinal", "int") >= 0),
        crs=~polygon | (value("$.srid") == "4326"), scope=~polygon | scope.isin("interior", "touch", "outside", "held"),
        hold=~polygon | ~held | ((hold != "") & (scope == "held") & wkb.isNull()), geometry=~polygon | held | ((scope != "held") & wkb.isNotNull()),
    )
    return records.select(
        *[F.col(f"`{c}`") for c in records.columns if c != "_lodestrata_v"], kind.alias("kind"), value("$.source_key").alias("source_key"), parent_kind.alias("parent_kind"), parent_key.alias("parent_key"),
        scope.alias("scope_relation"), hold.alias("hold"), F.sha2(F.col(text), 256).alias("input_sha256"), checks.alias("faults"),
    )
