import random

import pytest

from rolloutlake.llm import components, leaks, poisson, quotas, splits


def roots(df):
    return {r.vertex: r.root for r in df.collect()}


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for v in parent:
        groups.setdefault(find(v), set()).add(v)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("few", [0, 20, 2000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(3)
    edges = [(f"v{rng.randrange(60)}", f"v{rng.randrange(60)}") for _ in range(45)] + [(f"p{k}", f"p{k + 1}") for k in range(12)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame([*edges, edges[0], ("x", "x"), (None, "y")], "a string, b string")
    for algorithm in (components.random_mate, components.min_label):
        got = roots(algorithm(df))
        groups = {}
        for v, r in got.items():
            groups.setdefault(r, set()).add(v)
        assert {frozenset(g) for g in groups.values()} == brute(edges)
    assert all(r == min(g) for r, g in groups.items())
    assert roots(components.random_mate(df.limit(0))) == {}


def test_split_names(spark):
    df = spark.createDataFrame(
        [("v=Q1vcwLgLyBa", r"D:\clips\I-22UMprOB9\video.MP4", "sW0gVoF0LYu-Causal-16030"), (" kvhaH1wASTe ", "/mnt/pool2/clips/sW0gVoF0LYu_video_720p.mp4", None), ("5S8s28wjNzi.mp4", "./Videos/TSrVf7pRLYk/part_01_video.mp4", ""), (None, "store://omni/-KB3W5cB7e__video.mkv", "x")],
        "a string, b string, c string",
    )
    got = [tuple(r) for r in df.select(splits.video_of_id("a"), splits.video_of_path(df.b), splits.video_of_record(df.c)).collect()]
    assert got == [("Q1vcwLgLyBa", "I-22UMprOB9", "sW0gVoF0LYu"), ("kvhaH1wASTe", "sW0gVoF0LYu", None), ("5S8s28wjNzi", "TSrVf7pRLYk", None), (None, "-KB3W5cB7e_", None)]
    clips = spark.createDataFrame([("/data/vol2/ego/videos/00617/left_02.mp4",), (r"E:\ego\00357 (1).mp4",), ("/mnt/pool7/ego_2024/00002.MP4",), ("ego/videos/00199_720p.mp4",), (None,)], "p string")
    assert [r[0] for r in clips.select(splits.clip_of_path(clips.p)).collect()] == ["00617", "00357", "00002", "00199", None]


def test_clips_beyond_five_digits_are_read(spark):
    df = spark.createDataFrame([("/data/vol2/ego/videos/858123/left_02.mp4", "858123_77"), (r"E:\ego\100000 (1).mp4", "100000_5"), ("ego/videos/1234567_720p.mp4", "1234567_1"), ("/mnt/pool7/ego_2024/00002.MP4", "00002_9"), ("/mnt/2024/x.mp4", "2024_9")], "p string, i string")
    got = [tuple(r) for r in df.select(splits.clip_of_path(df.p), splits.clip_of_record(df.i)).collect()]
    assert got == [("858123", "858123"), ("100000", "100000"), ("1234567", "1234567"), ("00002", "00002"), (None, None)]


def test_split_groups_stay_whole(spark):
    rng = random.Random(1)
    weights = [(f"g{k}", rng.randrange(1, 6)) for k in range(2000)] + [("big", 900)]
    df = spark.createDataFrame(weights, "grp string, weight long")
    got = {r.grp: r.split for r in splits.cut_by_weight(df).collect()}
    assert len(got) == len(weights)
    total = sum(w for _, w in weights)
    for name, share in splits.PROPORTIONS:
        assert abs(sum(w for g, w in weights if got[g] == name) / total - share) < 0.02
    assert splits.cut_by_weight(df.limit(0)).collect() == []


def test_names_come_through_the_components(spark):
    rows = [
        (1, "t", [("t/video_id:v=a", "a"), ("t/id:b-1", "b")]),  # two names: one group, each row its own
        (2, "t", [("t/id:b-1", "b")]),
        (3, "t", [("t/video_id:c", "c"), ("t/audio_file:odd c", None)]),
        (4, "t", [("t/audio_file:odd c", None)]),  # named by row 3
        (5, "t", [("t/audio_file:odd c", None), ("t/id:?1", None)]),
        (6, "t", [("t/id:?1", None)]),  # named by row 3 through row 5
        (7, "t", [("t/video_id:c", "c"), ("t/video_file:x.mp4", None)]),
        (8, "t", [("t/video_id:d", "d"), ("t/video_file:x.mp4", None)]),
        (9, "t", [("t/video_file:x.mp4", None), ("t/id:?2", None)]),  # a common file name is no evidence
        (10, "t", []),
        (10, "t", []),
    ]
    df = spark.createDataFrame(rows, "row_id long, source_table string, readings array<struct<spelling string, name string>>")
    got = {r.row_id: (r.video, r.grp) for r in splits.grouped_rows(df).collect()}
    assert [got[k][0] for k in range(1, 11)] == ["a", "b", "c", "c", "c", "c", "c", "d", None, None]
    assert got[1][1] == got[2][1] and len({got[k][1] for k in (3, 4, 5, 6, 7)}) == 1 and len({got[k][1] for k in (1, 3, 8, 9, 10)}) == 5
    assert splits.grouped_rows(df.limit(0)).collect() == []


def test_quotas(spark):
    rows = [("f", "A & b", k) for k in range(400)] + [("f", "a_AND-B", k) for k in range(400, 500)] + [("f", "C", k) for k in range(500, 503)] + [("f", None, 900), ("f", " ", 901)]
    df = spark.createDataFrame(rows, "field_name string, category string, row_id long")
    targets = spark.createDataFrame([("f", "A and B", 90, 5), ("f", "c", 10, 5), ("f", "absent", 1, 2), ("g", "x", 50, 0)], "field_name string, category string, target_pct int, min_rows int")
    short = {(r.field_name, r.category): (r.have, r.wanted) for r in quotas.deficits(df, targets).collect()}
    assert short == {("f", "c"): (3, 6), ("f", "absent"): (0, 2)}
    sample = quotas.draw(df, targets).collect()
    assert sum(r.category == "A and B" for r in sample) == 46 and sum(r.category == "c" for r in sample) == 3
    assert {tuple(r) for r in quotas.draw(df.repartition(7), targets).collect()} == {tuple(r) for r in sample}


def test_poisson_keeps_what_it_selected(spark):
    rng = random.Random(9)
    rows = [("t", k, rng.randrange(1, 6), f"u{rng.randrange(300)}") for k in range(2000)]
    make = lambda part: spark.createDataFrame(part, "source_table string, row_id long, batch int, unit string")
    store = poisson.delivered(make([r for r in rows if r[2] <= 2]))
    early = {r.unit for r in poisson.selected(store).collect()}
    grown = poisson.carried(store, make([r for r in rows if r[2] > 2]))
    late = {r.unit for r in poisson.selected(grown).collect()}
    assert early <= late and 0 < len(early) < 300
    assert late == {r.unit for r in poisson.selected(poisson.delivered(make(rows).repartition(5))).collect()}


ITEM = "During the rehearsal in Wynilois 405 beige purses rolled past the cardboard carpet and 72 of them knocked an anchor."


def test_leaks(spark):
    items = spark.createDataFrame([(7, ITEM), (8, "too short"), (9, None)], "item_id long, text string")
    docs = spark.createDataFrame(
        [
            (1, "x. " + ITEM.upper().replace(" ", "  \n") + " y", "e"),
            (2, ITEM.replace("405", "31").replace("72", "9"), "e"),
            (3, ITEM.replace("rolled past", "rolled far past"), "e"),
            (4, None, "e"),
            (5, "", "e"),
            (6, " ".join(ITEM.split()[4:15]), "e"),
            (7, " ".join(ITEM.split()[4:16]) + " ", "e"),
            (8, "w " * 100_000 + ITEM, "e"),
        ],
        "doc_id long, text string, item_id string",
    )
    assert sorted(tuple(r) for r in leaks.literal_passages(docs, items).collect()) == [(1, 7), (7, 7), (8, 7)]
    reworked = {(r.doc_id, r.item_id) for r in leaks.reworked_passages(docs, items).collect()}
    assert (2, 7) in reworked
    assert leaks.literal_passages(docs.limit(0), items).collect() == []
    assert leaks.literal_passages(docs, items.limit(0)).collect() == []


def test_reworked_passages_are_found_among_others(spark):
    """Planted passages with other numbers, names and units in their slots: recall and precision against what was planted."""
    rng = random.Random(4)
    names, things = ["Wynilois", "Tarquin", "Belmora", "Ostrava"], ["purses", "carpets", "anchors", "lamps", "kettles", "ropes"]
    text = lambda name, a, b, unit, x, y: f"Every morning in {name} the keeper moves {a} {x} past the wide gate and {b} {unit} later {y} are counted by the clerk."
    items = [(k, text(names[k % 4], 10 + k, 300 + k, "minutes", things[k % 6], things[(k + 1) % 6])) for k in range(12)]
    docs, planted = [], set()
    for k in range(200):
        filler = " ".join(rng.choice(["tape", "fan", "log", "shelf", "river"]) for _ in range(30))
        if k % 2:
            i = rng.randrange(12)
            other = items[i][1].replace(names[i % 4], rng.choice(["Quill", "Zorbina"])).replace(str(10 + i), str(rng.randrange(500, 999))).replace(str(300 + i), str(rng.randrange(1000, 2000))).replace("minutes", "hours")
            docs.append((k, f"{filler} {other} {filler}"))
            planted |= {(k, j) for j in range(12) if j % 6 == i % 6}  # items with the same things are one template but for their slots
        else:
            docs.append((k, f"{filler} {' '.join(sorted(items[k % 12][1].split(), key=str.lower))}"))
    got = {(r.doc_id, r.item_id) for r in leaks.reworked_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert planted <= got and len(got) <= 1.05 * len({d for d, _ in planted}) * 12
    assert {d for d, _ in got} == {d for d, _ in planted}


def test_leaks_of_many_items_in_blocks(spark):
    items = spark.createDataFrame([(k, ITEM.replace("405", str(405 + k))) for k in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"x {ITEM.replace('405', str(405 + k))}") for k in range(0, 30, 3)], "doc_id long, text string")
    found = leaks.passages(docs, items, block_chars=500).where("doc_words = item_words").select("doc_id", "item_id").distinct()
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in leaks.literal_passages(docs, items).collect()} >= {(k, k) for k in range(0, 30, 3)}
