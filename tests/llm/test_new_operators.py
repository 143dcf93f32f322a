"""Collocations, licence scans and compaction: against plain definitions on small tables with the hard cases."""

import collections
import datetime
import glob
import hashlib
import random
import re
import zlib

import duckdb
import pytest
from common import clash
from pyspark.sql import functions as F

from lodestrata.llm import collocations, compaction, licences, queries, sql
from lodestrata.llm.scratch import Scratch

# --- collocations -------------------------------------------------------------------------------------------


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def plain_collocations(rows, least, top):
    count, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    count[lang or "und", tuple(ws[i : i + k])] += 1
    found = collections.defaultdict(list)
    candidates = {p: a for p, a in count.items() if len(p[1]) > 1 and a >= least}
    for (lang, p), a in candidates.items():
        inside = any(lang == m and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (m, q), b in candidates.items())
        if not inside:
            score, _, l, r = min((2_000_000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p)))
            found[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, k, p.decode(), -a, l, r, total[lang], -s) for lang, rows in found.items() for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)}


def phrase_rows():
    rng = random.Random(3)
    words = ["Alpha", "beta", "gam ma", "é", "日本", "x", "y", "z", "Q-1"]
    rows = [(("en", "de", None, "und")[k % 4], "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ". ", "\n", ",", " \r "]) for _ in range(rng.randrange(80)))) for k in range(120)]
    rows += [("en", None), ("en", ""), ("en", " \t ..!"), (None, "one two three four. " * 50), ("fr", "a b " * 3000), ("fr", "only once here")] + rows[:7]
    return rows


@pytest.mark.parametrize("block_bytes", [200, 8_000_000])
def test_collocations_equal_brute_force(spark, block_bytes):
    rows = phrase_rows()
    docs = clash(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    got = collocations.collocations(docs, Scratch(spark, "phrases"), top=40, least=5, block_bytes=block_bytes).collect()
    want = plain_collocations(rows, 5, 40)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 60


def test_collocations_of_nothing(spark):
    for rows in ([], [(None, None)], [("en", "a b")]):
        docs = spark.createDataFrame(rows, "lang string, text string")
        assert collocations.collocations(docs, Scratch(spark, "phrases")).collect() == []


def test_collocation_counts_beyond_64_bits(spark):
    """Exact scores where a product passes 64 bits and a double would round."""
    big = 4_611_686_018_427_387_903
    found = [spark.createDataFrame([("en", "a", big), ("en", "b", big - 2)], "lang string, phrase string, a long"), spark.createDataFrame([("en", "a b", big - 4)], "lang string, phrase string, a long")]
    empty = found[1].limit(0)
    row = collocations._scored([*found, empty, empty]).first()
    assert row.score == 2_000_000 * (big - 4) // (2 * big - 2)


# --- licences -----------------------------------------------------------------------------------------------


def plain_runs(words, sequences, least):
    """(end, template, end in it, words) of all maximal common runs."""
    out = set()
    for t, ids in enumerate(sequences):
        for i in range(len(words)):
            for j in range(len(ids)):
                if words[i] == ids[j] and not (i and j and words[i - 1] == ids[j - 1]):
                    n = 0
                    while i + n < len(words) and j + n < len(ids) and words[i + n] == ids[j + n]:
                        n += 1
                    if n >= least:
                        out.add((i + n, t, j + n, n))
    return out


def plain_scan(text, templates, phrases):
    words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))]
    sequences = [licences.words_of(t.encode()) for _, t in templates.values()]
    places = sorted((i, p) for p, x in enumerate(phrases) for i in range(len(words)) if words[i : i + len(x.split())] == [w.encode() for w in x.split()])
    chains = []  # (template, first, end, place, covered)
    spans, best = [], 0.0
    runs = plain_runs(words, sequences, licences.LEAST_RUN)
    for end in sorted({r[0] for r in runs}):
        new = []
        for _, t, place, n in sorted(r for r in runs if r[0] == end):
            begin, first = end - n, place - n
            options = [(n, begin)]
            for c in chains:
                over = max(0, c[2] - begin, c[3] - first)
                if c[0] == t and over < n and c[2] + licences.MOST_GAP >= begin + over:
                    options.append((c[4] + n - over, c[1]))
            covered = max(o[0] for o in options)
            new.append((t, {o[1] for o in options if o[0] == covered}, end, place, covered))
            share = covered / len(sequences[t])
            best = max(best, share)
            if share >= licences.LEAST_SHARE:
                spans.append((share, covered, end, list(templates.values())[t][0]))
        chains += [(t, min(f), e, p, c) for t, f, e, p, c in new]
    return len(words), places, spans, min(1.0, best)


def licence_texts():
    rng = random.Random(8)
    full = [t for _, t in licences.TEMPLATES.values()]
    texts = ["", "MIT License", "the mit LICENSE, apache license; Apache-License! general public license", "mit\x00license", "mit licensé", "x" * 5000]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            ws = rng.choice(full).split()
            lo = rng.randrange(len(ws))
            ws = ws[lo : lo + rng.randrange(2, 40)]
            if rng.random() < 0.5:
                ws[rng.randrange(len(ws))] = rng.choice(["other", "the", "license", ""])
            parts.append(rng.choice([" ", "\n# ", "-"]).join(ws) + " " + "filler " * rng.choice([0, 1, 5, 29, 30, 31]))
        texts.append("".join(parts))
    return texts + full


def test_automaton_equals_plain_matches():
    made = licences.build()
    for text in licence_texts():
        n, places, spans, score = licences.scan_text(made, text.encode())
        want_n, want_places, want_spans, want_score = plain_scan(text, licences.TEMPLATES, licences.PHRASES)
        assert (n, sorted(places), score) == (want_n, want_places, pytest.approx(want_score))
        best = max(want_spans, default=None)
        assert (best is None) == (not spans)
        if best:  # the span of the greatest share stays, and nothing stands that is no span
            assert max((s[3], s[2]) for s in spans) == pytest.approx(best[:2])
            assert all(any(abs(s[3] - w[0]) < 1e-12 and s[1] == w[2] for w in want_spans) for s in spans)
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_licence_windows_do_not_matter(monkeypatch):
    made = licences.build()
    text = " ".join(licence_texts()).encode()
    whole = licences.scan_text(made, text)
    for window in (7, 64, 1000):
        monkeypatch.setattr(licences, "WINDOW", window)
        assert licences.scan_text(made, text) == whole


def test_licence_rows(spark):
    rows = [(1, "Released under the MIT License."), (2, None), (None, ""), (4, "This work is licensed under the GNU General Public License, version 3."), (4, "words only"), (5, licences.TEMPLATES["bsd"][1].upper())]
    docs = clash(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("labels", F.lit("own"))
    got = [tuple(r)[1:8] for r in licences.scan_licences(docs.repartition(1)).collect()]
    want = [(5, 1, 3, 3, "mit", "mit", 1.0), (0, 0, None, None, "", "", 0.0), (0, 0, None, None, "", "", 0.0), (12, 1, 7, 7, "gpl", "gpl,gpl-3.0", 1.0), (2, 0, None, None, "", "", 0.0)]
    assert sorted(map(str, got)) == sorted(map(str, [*want, (len(licences.TEMPLATES["bsd"][1].split()), 0, None, None, "", "bsd", 1.0)]))
    assert licences.scan_licences(docs.limit(0)).count() == 0


# --- compaction ---------------------------------------------------------------------------------------------


def first_fit(sizes, capacity):
    """Bins of the places in a descending list of sizes, one file at a time."""
    bins, room = [], []
    for k, size in enumerate(sizes):
        at = next((b for b, left in enumerate(room) if left >= size), None)
        if at is None:
            bins.append([])
            room.append(capacity)
            at = len(bins) - 1
        bins[at].append(k)
        room[at] -= size
    return bins


def test_runs_pack_like_single_files():
    rng = random.Random(4)
    for trial in range(400):
        capacity = rng.randrange(1, 60)
        sizes = sorted((rng.randrange(1, rng.choice([4, 20, 80])) for _ in range(rng.randrange(0, 60))), reverse=True)
        counts = sorted(collections.Counter(sizes).items(), reverse=True)
        begin = {s: sizes.index(s) for s, _ in counts}
        got = collections.defaultdict(list)
        for b, size, first, taken in compaction.pack_runs([s for s, _ in counts], [n for _, n in counts], capacity):
            got[b] += range(begin[size] + first, begin[size] + first + taken)
        assert [got[b] for b in range(len(got))] == first_fit(sizes, capacity), trial


EPOCH = datetime.datetime(1970, 1, 1)


def crc(x):
    return zlib.crc32(b"" if x is None else str(x).encode())


def plain_compaction(rows):
    """Final files by (day, first lot, first piece): (sources, rows in order)."""
    n = len(rows)
    share = lambda x: 1 + n // x
    days = collections.Counter(None if r["arrived_at"] is None else (r["arrived_at"] - EPOCH).days for r in rows)
    parts = collections.defaultdict(list)
    for r in rows:
        day, h = None if r["arrived_at"] is None else (r["arrived_at"] - EPOCH).days, crc(r["click_id"])
        parts[day, (h // 16) % (1 + days[day] // share(150)), min(h % 4, h // 4 % 4)].append(r)
    none_first = lambda v: (v is not None, v if v is not None else 0)
    for found in parts.values():
        found.sort(key=lambda r: tuple(none_first(v) for v in (None if r["arrived_at"] is None else r["arrived_at"].timestamp(), r["click_id"])))
    final = {}
    for day in days:
        own = sorted(((-len(v), k[1], k[2]) for k, v in parts.items() if k[0] == day))
        light = [x for x in own if -x[0] < share(600)]
        for x in own:
            if -x[0] >= share(600):
                final[day, x[1], x[2]] = (f"{x[1]}-{x[2]}", parts[day, x[1], x[2]], False)
        for members in first_fit([-x[0] for x in light], share(400)):
            keys = [light[k][1:] for k in members]
            final[(day, *keys[0])] = (",".join(f"{a}-{b}" for a, b in keys), [r for k in keys for r in parts[(day, *k)]], len(keys) > 1)
    return final


def check_files(spark, out, rows):
    final, got = plain_compaction(rows), {(r.day, r.lot, r.piece): r for r in out}
    assert set(got) == set(final) and len(out) == len(final)
    for key, (sources, content, rewritten) in final.items():
        r, ids = got[key], [x["click_id"] for x in content]
        known = [i for i in ids if i is not None]
        cents = sum(0 if x["value"] is None else int((100 * x["value"] + 0.5) // 1) for x in content)
        assert (r.sources, r.n_rows, r.rewritten, r.cents) == (sources, len(content), rewritten, cents)
        assert (r.min_click_id, r.max_click_id) == (min(known, default=None), max(known, default=None))
        assert r.ids_sha256 == hashlib.sha256(",".join("" if i is None else str(i) for i in ids).encode()).hexdigest()
        stored = duckdb.sql(f"select click_id from read_parquet('{r.path.removeprefix('file://').removeprefix('file:')}', hive_partitioning=false)").fetchall()
        assert [x[0] for x in stored] == ids
    return got


def awkward_clicks(spark):
    rng, rows = random.Random(6), []
    for k in range(900):
        day = 0 if k % 3 == 0 else rng.randrange(12)  # one day holds more than a third
        at = EPOCH + datetime.timedelta(days=19_700 + day, seconds=rng.randrange(30))
        rows.append((k // 2 if k % 5 else None, at if k % 50 else None, rng.choice([None, 1.005, -2.5, 3.25]), rng.choice(["", "x" * 3000, None]), 7))
    rows += rows[:20]
    return spark.createDataFrame(rows, "click_id long, arrived_at timestamp_ntz, value double, props string, day int")


def test_compaction_equals_plain_packing(spark):
    clicks = awkward_clicks(spark).withColumns({"lot": F.lit("own"), "bin": F.lit(3), "Path": F.lit(1.5), "_day": F.lit(0), "_metadata": F.lit("m")})
    scratch = Scratch(spark, "compact")
    out = compaction.compact_clicks(spark, clicks, f"{scratch.path}/clicks", scratch.keep).collect()
    got = check_files(spark, out, [r.asDict() for r in clicks.collect()])
    assert any(r.rewritten for r in got.values()) and any(not r.rewritten for r in got.values())
    assert {r.columns for r in got.values()} == {",".join(clicks.columns)}
    folder = compaction.Folder(spark, scratch.path)
    assert not folder.there(f"{scratch.path}/clicks.merged")


def test_compaction_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/clicks.parquet").select("click_id", "arrived_at", "value").collect()]
    check_files(spark, queries.op11_compaction(spark, sf).collect(), rows)


def test_compaction_of_nothing(spark):
    clicks, scratch = awkward_clicks(spark).limit(0), Scratch(spark, "compact")
    assert compaction.compact_clicks(spark, clicks, f"{scratch.path}/clicks", scratch.keep).collect() == []


def test_untouched_files_stay_and_a_broken_swap_goes_on(spark, monkeypatch):
    scratch = Scratch(spark, "compact")
    clicks = awkward_clicks(spark).drop("day").filter("arrived_at is not null")
    keys = {"day": F.unix_date(F.col("arrived_at").cast("date")).cast("long"), "lot": F.lit(0).cast("long"), "piece": F.coalesce(F.col("click_id") % 7, F.lit(9))}
    parts = compaction.write_parts(clicks, f"{scratch.path}/clicks", keys, ["arrived_at", "click_id"])
    found = scratch.keep(compaction.part_rows(spark, parts), "parts")
    plan = scratch.keep(compaction.plan_bins(found, "day", ["lot", "piece"], 12, 20), "plan")

    def bytes_of():
        return {f: hashlib.sha256(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{parts.path.removeprefix('file://')}/*/*/*/*.parquet")}

    before, rows = bytes_of(), sorted(map(str, parts.read(spark).drop(*parts.keys).collect()))
    assert len(before) == found.count()
    moves, real = [], compaction.Folder.move

    def failing(self, old, new):
        moves.append(new)
        if len(moves) == 3:
            raise OSError("lost")
        real(self, old, new)

    monkeypatch.setattr(compaction.Folder, "move", failing)
    with pytest.raises(OSError):
        compaction.merge_bins(spark, parts, plan)
    monkeypatch.setattr(compaction.Folder, "move", real)
    compaction.merge_bins(spark, parts, plan)
    after = bytes_of()
    assert sorted(map(str, parts.read(spark).drop(*parts.keys).collect())) == rows
    concerned = {f"day={r.day}/lot={r.lot}/piece={r.piece}/" for r in plan.collect()}
    stay = {f: h for f, h in before.items() if not any(c in f for c in concerned)}
    assert stay and stay.items() <= after.items()
    assert len(after) == len(stay) + plan.filter("place = 1").count()
    compaction.merge_bins(spark, parts, plan)  # nothing is left to do
    assert bytes_of() == after


def test_collocation_sql_on_a_small_corpus(spark):
    """The SQL of the query, on rows that reach its least frequency."""
    rows = [(k, *r) for k, r in enumerate(phrase_rows() * 6)]
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, lang varchar, text varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    got = collocations.collocations(spark.createDataFrame(rows, "doc_id long, lang string, text string"), Scratch(spark, "phrases")).collect()
    found = con.sql(sql.OP13_SQL)
    place = [found.columns.index(c) for c in got[0].asDict()]
    assert {tuple(r) for r in got} == {tuple(r[k] for k in place) for r in found.fetchall()}
