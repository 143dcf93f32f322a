"""Append-only history: the latest event decides, staleness is computed, replays change nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.digest import EMPTY_FINGERPRINT, tree_fingerprint


def latest(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last event of each key by ``order``: a map-side aggregate, no sort and no window."""
    rest = [c for c in events.columns if c not in key]
    top = events.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_e"))
    return top.select(*key, *[F.col(f"_e.{c}").alias(c) for c in rest])


def needs_revisit(current: DataFrame, key: list[str], resolved: Column, at: str, occurrences: DataFrame, occurred: str) -> DataFrame:
    """Add ``needs_revisit``: the current state is resolved and something occurred after it."""
    last = occurrences.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.max(occurred).alias("_last"))
    match = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in key])
    stale = resolved & F.coalesce(F.col("_last") > F.col(at), F.lit(False))
    return current.join(last, match, "left").select(*current.columns, F.coalesce(stale, F.lit(False)).alias("needs_revisit"))


def effective(base: DataFrame, changes: DataFrame, key: list[str], fields: dict[str, str], accepted: Column) -> DataFrame:
    """Rows of ``base`` with fields of accepted changes in place of their own; the rest as it was.

    ``changes`` has one row a key (its latest event). ``fields`` maps a field of ``base`` to the column of
    ``changes`` that replaces it. Adds ``change_applied``.
    """
    wanted = changes.filter(accepted).select(*[F.col(k).alias(f"_{k}") for k in key], *[F.col(v).alias(f"_new_{f}") for f, v in fields.items()], F.lit(True).alias("_hit"))
    match = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in key])
    applied = F.coalesce("_hit", F.lit(False))
    value = lambda c: F.when(applied, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
    return base.join(wanted, match, "left").select(*[value(c) for c in base.columns], applied.alias("change_applied"))


def dependency_map(events: DataFrame, key: list[str], name: str, value: str) -> DataFrame:
    """(key, dependencies): canonical JSON of the last ``value`` per ``name``, sorted by name."""
    last = events.groupBy(*key, name).agg(F.max(value).alias("_v"))
    entry = F.concat(F.lit('"'), F.col(name), F.lit('":'), F.col("_v").cast("string"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), entry.alias("e"))))
    return last.groupBy(*key).agg(F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda x: x["e"]), ","), F.lit("}")).alias("dependencies"))


def snapshot_state(recorded: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """Compare recorded dependency digests with the ones computed now: key, recorded and current ids, is_current."""
    digest = lambda side: [*[F.col(k) for k in key], F.sha2("dependencies", 256).alias(side)]
    both = recorded.select(*digest("recorded_id")).join(current.select(*digest("current_id")), key, "full_outer")
    return both.select(*key, "recorded_id", "current_id", F.col("recorded_id").eqNullSafe(F.col("current_id")).alias("is_current"))


def new_rows(incoming: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """What an idempotent append writes: incoming rows whose key is not stored, one for each key."""
    return incoming.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def replay_conflicts(incoming: DataFrame, stored: DataFrame, key: list[str], ignore: tuple[str, ...] = ()) -> DataFrame:
    """Keys that come again with another payload (columns in ``ignore`` aside)."""
    payload = [c for c in incoming.columns if c not in key and c not in ignore]
    other = stored.select(*[F.col(k).alias(f"_{k}") for k in key], *[F.col(c).alias(f"_{c}") for c in payload])
    match = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in key])
    differ = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in payload], F.lit(False))
    return incoming.join(other, match).filter(differ).select(*key)


def own_conflicts(incoming: DataFrame, key: list[str]) -> DataFrame:
    """Keys that one batch holds with several payloads; equal rows are one."""
    payload = [c for c in incoming.columns if c not in key]
    digest = F.sha2(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}) if payload else F.lit(""), 256)
    return incoming.groupBy(*key).agg(F.min(digest).alias("_low"), F.max(digest).alias("_high")).filter(F.col("_low") != F.col("_high")).select(*key)


def changed_or_removed(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Immutability guard: stored rows that a new version of the table lacks or alters (must be empty)."""
    return before.exceptAll(after.select(*before.columns)).select(*key).distinct()


def plan_append(head: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Decide each incoming event against the head of its key, optimistically.

    ``head`` has (key, head_id); ``incoming`` has (key, event_id, expected_id, ...). Adds ``decision``: append if
    the expectation equals the head (both may be absent), else stale. One event a key can win in a call.
    """
    renamed = head.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("head_id"))
    match = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in key])
    joined = incoming.join(renamed, match, "left")
    fits = F.col("expected_id").eqNullSafe(F.col("head_id"))
    first = incoming.groupBy(*key, "expected_id").agg(F.min("event_id").alias("_first")).select(*[F.col(k).alias(f"_f_{k}") for k in key], F.col("expected_id").alias("_f_expected"), "_first")
    again = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_f_{k}") for k in key]) & F.col("expected_id").eqNullSafe(F.col("_f_expected"))
    decided = joined.join(first, again, "left")
    return decided.select(*incoming.columns, F.when(~fits, "stale").when(F.col("event_id") != F.col("_first"), "stale").otherwise("append").alias("decision"))


def incomplete_batches(features: DataFrame, manifest: DataFrame, key: list[str], id_column: str, digest: str) -> DataFrame:
    """Completeness before publishing: batches whose count or fingerprint is not the manifest's."""
    from lodestrata.functions.digest import ordered_fingerprint

    found = ordered_fingerprint(features, key, [id_column], digest).withColumnsRenamed({"n_rows": "_n", "fingerprint": "_f"})
    both = manifest.join(found, key, "full_outer")
    wrong = ~(F.col("n_rows").eqNullSafe(F.col("_n")) & F.col("fingerprint").eqNullSafe(F.col("_f")))
    return both.filter(wrong).select(*key)


def latest_with_staleness(results: DataFrame, revisions: DataFrame, key: list[str], order: list[str], inputs: str, current_inputs: DataFrame) -> DataFrame:
    """The last revision of each result (else the result), with ``is_stale`` against the inputs as they are now."""
    last = latest(revisions, key, order)
    fresh = last.select(*[F.col(k).alias(f"_{k}") for k in key], *[F.col(c).alias(f"_r_{c}") for c in results.columns if c not in key])
    match = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in key])
    merged = results.join(fresh, match, "left").select(*key, *[F.coalesce(f"_r_{c}", c).alias(c) for c in results.columns if c not in key], F.col(f"_{key[0]}").isNotNull().alias("revised"))
    now = current_inputs.select(*[F.col(k).alias(f"_{k}") for k in key], F.col(inputs).alias("_now"))
    return merged.join(now, match, "left").select(*merged.columns, (~F.col(inputs).eqNullSafe(F.col("_now"))).alias("is_stale"))


def orphans(children: DataFrame, parents: DataFrame, child_key: list[str], parent_key: list[str]) -> DataFrame:
    """Children that name a parent which is not there."""
    named = parents.select(*[F.col(p).alias(c) for c, p in zip(child_key, parent_key, strict=True)])
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in child_key])
    return children.filter(present).join(named, child_key, "left_anti")


def scoped_staleness(results: DataFrame, inputs: DataFrame, scope: list[str], id_column: str, digest: str) -> DataFrame:
    """Add ``is_stale`` to results (scope, dependencies): only changes within a result's own scope count.

    ``inputs`` are the current inputs (scope, id, digest); a scope's fingerprint is order-free and folded before
    it is joined. ``dependencies`` is the fingerprint that a result was made from; an empty scope has that of nothing.
    """
    now = scope_fingerprint(inputs, scope, id_column, digest)
    renamed = now.select(*[F.col(k).alias(f"_{k}") for k in scope], F.col("dependencies").alias("_now"))
    match = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in scope])
    stale = ~F.col("dependencies").eqNullSafe(F.coalesce("_now", F.lit(EMPTY_FINGERPRINT)))
    return results.join(renamed, match, "left").select(*results.columns, stale.alias("is_stale"))


def scope_fingerprint(inputs: DataFrame, scope: list[str], id_column: str, digest: str) -> DataFrame:
    """(scope, dependencies): the order-free SHA-256 identity of the (id, digest) pairs of each scope."""
    pairs = inputs.select(*scope, F.to_json(F.struct(F.col(id_column).alias("id"), F.col(digest).alias("d")), {"ignoreNullFields": "false"}).alias("_pair"))
    return tree_fingerprint(pairs, scope, "_pair").select(*scope, F.col("fingerprint").alias("dependencies"))


def bound_coverage(coverage: DataFrame, snapshots: DataFrame, acceptances: DataFrame) -> DataFrame:
    """Coverage results with what they still rest on: add ``currency`` (current, superseded, unaccepted or unknown).

    ``coverage``: scope, snapshot_id, ...; ``snapshots``: scope, snapshot_id (the current one of each scope);
    ``acceptances``: scope, event_seq, status. A result holds for the snapshot it was computed from, and only while
    the last event of its scope accepts the geometry.
    """
    head = snapshots.select(F.col("scope").alias("_scope"), F.col("snapshot_id").alias("_now"))
    last = acceptances.groupBy(F.col("scope").alias("_of")).agg(F.max_by("status", "event_seq").alias("_last"))
    both = coverage.join(head, F.col("scope") == F.col("_scope"), "left").join(last, F.col("scope") == F.col("_of"), "left")
    currency = F.when(F.col("_now").isNull(), "unknown").when(F.col("_now") != F.col("snapshot_id"), "superseded").when(~F.col("_last").eqNullSafe(F.lit("accepted")), "unaccepted").otherwise("current")
    return both.select(*coverage.columns, currency.alias("currency"))
