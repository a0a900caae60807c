import random

import pytest
from pyspark.sql import functions as F

from loamdex.llm import mixing, packing, queries, residue
from loamdex.llm.tokens import VOCABULARY, encoding, token_counts

DOCS = "doc_id bigint, text string, source string"


def docs(spark, rows, clash=True):
    df = spark.createDataFrame([(i, t, s) for i, t, s in rows], DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("tokens", "key", "profile", "node", "piece", "times", "h", "quality", "range")}) if clash else df


# ------------------------------------------------------------------------------------------------------------- tokens


def test_token_counts(spark):
    text = "The ferry praised 12 windows.\n\n  Don't! " * 30
    rows = docs(spark, [(1, text, "a"), (1, text, "a"), (2, None, "a"), (3, "", "a"), (None, "x", "a"), (4, "héllo 世界", None)])
    got = {r["doc_id"]: r["tokens"] for r in token_counts(rows, VOCABULARY).collect()}
    assert got == {1: len(encoding(VOCABULARY).encode_ordinary(text)), 2: 0, 3: 0, 4: len(encoding(VOCABULARY).encode_ordinary("héllo 世界"))}
    assert encoding(VOCABULARY).decode(encoding(VOCABULARY).encode_ordinary(text)) == text


# ------------------------------------------------------------------------------------------------------------ packing


@pytest.mark.parametrize("seed", range(12))
def test_plan_uses_each_item_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 32, 100, 512])
    counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(1, 60))}
    used = {}
    containers = 0
    for pattern, m in packing.plan(dict(counts), capacity):
        assert sum(pattern) <= capacity and m > 0
        containers += m
        for s in pattern:
            used[s] = used.get(s, 0) + m
    assert used == counts
    total = sum(s * n for s, n in counts.items())
    # best fit never leaves two containers that would go into one
    assert containers <= max(1, 1.7 * total / capacity + 1)


def test_exact_complements():
    assert packing.plan({7: 3, 3: 3}, 10) == [([7, 3], 3)]
    assert packing.plan({6: 1, 3: 1, 1: 1}, 10) == [([6, 3, 1], 1)]
    assert packing.plan({5: 1, 3: 1, 1: 2}, 10) == [([5, 3, 1, 1], 1)]
    assert packing.plan({10: 4}, 10) == [([10], 4)] and packing.plan({}, 10) == []
    # many small items: no room but in the last container
    n = sum(m for _, m in packing.plan({s: 50 for s in range(1, 40)}, 512))
    assert n == -(-50 * sum(range(1, 40)) // 512)


def test_containers(spark):
    word = "harbor ferry goose "
    rng = random.Random(5)
    rows = [(i, word * rng.randint(1, 90), "a") for i in range(1, 200)] + [(200, word * 900, "a"), (201, None, "a"), (202, "", "a"), (5, None, "a")]
    sizes = spark.createDataFrame([("s", 64), ("l", 512), ("l", 512), ("none", 0)], "profile string, capacity int")
    got = packing.containers(docs(spark, rows), sizes).toPandas()
    counts = {r["doc_id"]: r["tokens"] for r in token_counts(docs(spark, rows), VOCABULARY).collect()}
    for profile, capacity in (("s", 64), ("l", 512)):
        g = got[got.profile == profile]
        assert not g.duplicated(["doc_id", "piece"]).any() and g.groupby("doc_id").tokens.sum().to_dict() == counts
        per = g.groupby("container").tokens.sum()
        assert per.max() <= capacity and set(per.index) == set(range(1, len(per) + 1)) and len(per) <= 1.02 * -(-g.tokens.sum() // capacity) + 1
        split = g[g.piece > 1].doc_id.unique()
        assert all(counts[d] > capacity for d in split) and (g[g.tokens == 0].container == 1).all()
    room = {r["profile"]: r for r in packing.unused_room(docs(spark, rows), sizes).collect()}
    assert room["l"]["unused"] == room["l"]["containers"] * 512 - sum(counts.values()) and room["l"]["fullest"] <= 512
    assert packing.containers(docs(spark, rows).limit(0), sizes).count() == 0 and packing.containers(docs(spark, rows), sizes.limit(0)).count() == 0
    assert sorted(map(tuple, packing.containers(docs(spark, rows), sizes).collect())) == sorted(map(tuple, got.itertuples(index=False)))


def test_p6_checked_counts_only_documents_placed_whole(spark, tmp_path, monkeypatch):
    rows = [(i, "harbor ferry " * i, "a") for i in range(1, 40)] + [(50, "harbor ferry " * 300, "a"), (51, None, "a"), (52, "", "a"), (5, "harbor ferry " * 5, "a"), (None, "x", "a")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("s", 64), ("s", 512), ("l", 512), ("l", 512)], "profile string, capacity int").write.parquet(f"{tmp_path}/pack_sizes.parquet")

    def checked():
        return sorted(map(tuple, queries.p6_checked(spark, str(tmp_path)).collect()))

    # two capacities under one name are two rows, whose containers aren't added up
    assert checked() == [("l", 512, 42, 0, 0), ("s", 64, 42, 0, 0), ("s", 512, 42, 0, 0)]
    real = packing.containers
    # the last piece of a long document is lost, and a short document is placed twice
    monkeypatch.setattr(packing, "containers", lambda *a: (x := real(*a)).where("not (doc_id = 50 and tokens < capacity)").unionByName(x.where("doc_id = 1").withColumn("container", F.col("container") + 1000)))
    assert [r[2] for r in checked()] == [40, 40, 40]
    # nothing is placed: the profiles are still there, as in SQL
    monkeypatch.setattr(packing, "containers", lambda *a: real(*a).limit(0))
    assert checked() == [("l", 512, 0, 0, 0), ("s", 64, 0, 0, 0), ("s", 512, 0, 0, 0)]


# ------------------------------------------------------------------------------------------------------------- mixing


def test_draw_reaches_its_shares(spark):
    rng = random.Random(6)
    rows = [(i, "goose " * rng.randint(5, 60), "abc"[i % 3] if i % 5 else "a") for i in range(1, 900)] + [(1000 + i, "tar " * 20, "small") for i in range(6)]
    rows += [(2000, None, "a"), (2001, "", "a"), (2002, "x y z", None), (2003, "x y", "untargeted"), (1, rows[0][1], rows[0][2])]
    targets = spark.createDataFrame([("a", 0.3, 4), ("b", 0.3, 2), ("c", 0.35, 2), ("small", 0.05, 3), ("absent", 0.1, 2), (None, 0.2, 1), ("b", 0.3, 2)], "source string, target_share double, max_repeats int").withColumn("tokens", F.lit("clash"))
    d = docs(spark, rows)
    got = mixing.draw(d, targets).toPandas()
    assert not got.doc_id.duplicated().any() and set(got.source) == {"a", "b", "c", "small"} and (got[got.source == "small"].times == 3).all()
    shares = {r["source"]: r for r in mixing.shares(d, targets).collect()}
    total = sum(r["tokens"] for r in shares.values())
    for s, goal in (("a", 0.3), ("b", 0.3), ("c", 0.35), ("small", 0.05)):
        assert abs(shares[s]["tokens"] / total - goal) < 0.02 and shares[s]["most_times"] <= shares[s]["max_repeats"]
    assert shares["absent"]["tokens"] == 0
    # a complete epoch comes before any second draw
    big = mixing.draw(d, targets, total_tokens=int(2.2 * got.tokens.sum() + 40_000)).toPandas()
    for s, g in big.groupby("source"):
        assert g.times.max() - g.times.min() <= 1 and (g.times.min() >= 1 if g.times.max() > 1 else True)
    assert mixing.draw(d.limit(0), targets).count() == 0 and mixing.draw(d, targets.limit(0)).count() == 0
    assert sorted(map(tuple, mixing.draw(d, targets).collect())) == sorted(map(tuple, got.itertuples(index=False)))


def test_order_equals_a_plain_sort(spark):
    """Which documents a budget takes is what sorting a whole source by its keys would give."""
    rng = random.Random(8)
    rows = [(i, "goose " * rng.randint(1, 40), "a") for i in range(1, 400)] + [(500, "tar " * 50, "b")]
    targets = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 1)], "source string, target_share double, max_repeats int")
    got = {r["doc_id"] for r in mixing.draw(docs(spark, rows), targets).where("source = 'a'").collect()}
    w = mixing._weighed(docs(spark, rows), targets, VOCABULARY, mixing.SEED).toPandas()
    a = w[w.source == "a"].sort_values(["key", "doc_id"])
    budget = 0.9 * (w[w.source == "b"].tokens.sum() / 0.1)
    run, want = 0, set()
    for i, n in zip(a.doc_id, a.tokens):
        if run + n / 2 > budget:
            break
        want.add(i)
        run += n
    assert got == want and 0 < len(got) < 399


def test_better_pages_come_sooner(spark):
    boxes = "array<struct<conf: double>>"
    rows = [(i, "goose tar " * 10, "a", [(0.98 if i % 2 else 0.1,), (None,)]) for i in range(1, 600)] + [(700, "x " * 60, "b", None), (701, "x " * 60, "b", [])]
    d = spark.createDataFrame(rows, f"doc_id bigint, text string, source string, line_boxes {boxes}")
    targets = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 1)], "source string, target_share double, max_repeats int")
    got = [r["doc_id"] for r in mixing.draw(d, targets).where("source = 'a'").collect()]
    assert sum(i % 2 for i in got) > 0.8 * len(got)


def test_p7_checked_sees_shares_that_are_not_reached(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    rows = [(i, "goose " * rng.randint(5, 60), "abc"[i % 3]) for i in range(1, 400)] + [(1000 + i, "tar " * 20, "small") for i in range(6)] + [(2000, None, "a"), (2001, "", "a"), (2002, "x y", None), (2003, "x y", "untargeted")]
    docs(spark, [*rows, rows[0]]).write.parquet(f"{tmp_path}/documents.parquet")
    goals = [("a", 0.3, 4), ("b", 0.3, 2), ("c", 0.35, 2), ("small", 0.05, 3), ("absent", 0.1, 2), ("never", 0.0, 2), ("unset", None, 2), ("b", 0.3, 2)]
    spark.createDataFrame(goals, "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    n = {"a": 133, "b": 133, "c": 133, "small": 6}
    good = {s: (share, n.get(s, 0), 0, 0) for s, share, _ in goals}

    def checked():
        got = queries.p7_checked(spark, str(tmp_path)).collect()
        assert len(got) == len(good)
        return {r[0]: tuple(r[1:]) for r in got}

    assert checked() == good
    real = mixing.draw
    # every second page of a source isn't drawn
    monkeypatch.setattr(mixing, "draw", lambda *a: real(*a).where("source <> 'b' or doc_id % 2 = 0"))
    got = checked()
    assert got.pop("b")[0] < 0.2 and got == {k: v for k, v in good.items() if k != "b"}
    # nothing is drawn
    monkeypatch.setattr(mixing, "draw", lambda *a: real(*a).limit(0))
    assert {s: r[0] for s, r in checked().items()} == {s: share if s in ("absent", "never", "unset") else 0.0 for s, share, _ in goals}
    # a page over its cap in two rows
    monkeypatch.setattr(mixing, "draw", lambda *a: (x := real(*a)).unionByName(x.where("doc_id = 1000")))
    assert checked()["small"][2] == 1


# ------------------------------------------------------------------------------------------------------------ residue

NEWS = "The harbour board praised several broken windows.\nWheat 12s., barley 8s., oats 4s. the quarter."
FOUND = {1: "Please enable JavaScript to view this page.", 2: NEWS + "\nPlea5e enable JavaScrlpt to\nview this p0ge.\n" + NEWS, 3: "{{headline}}\n" + NEWS, 4: NEWS + "\n[Insert caption here]", 5: "Dolor tortor vitae ornare praesent lorem\nNuilam dictum", 6: "502 Bad Gateway",
         7: "Traceback (most recent call last): File \"/srv/x/ocr.py\", line 3", 8: "blah blah blah", 9: "This viewer does not work  To Mrs. Crosby, at Bramton,\nwithout scripts. Update your  a daughter, weighing 8\nbrowser.  pounds. Lost between", 10: "Dies ist ein BIindtext und zeigt\nnur den Satzspiegel.",
         11: "CAPTION GOES HERE", 12: "Your session has expired. Please sign in again.", 13: "Veuillez activer JavaScript pour afficher cette page", 14: "Su navegador no adrnite marcos.", 15: "The grain market sold the old\nfoo bar baz foo bar\nfoo bar baz foo bar\nbridge on Tuesday."}
PRINTED = {21: NEWS, 22: "Readers whose machine says 'please enable JavaScript' may ask Mr. Tolland at the library on\nThursday.", 23: "The telegram came back marked 'address not found', and the boy kept the shilling.", 24: "Lot [40] went to {Pellam} for $5 and costs.", 25: "In all 59 pages were counted, among them 404 of verse.",
           26: "Access to the quay is denied to carts of more than 9 stone.", 27: "An internal error in the ledger of the mill was put right.", 28: "Miss Gorley recited 'Lorem ipsum dolor' and nobody understood him.", 29: "", 30: None, 31: "x" * 60_000, 32: "The council office is temporarily unavailable while the roof is mended.",
           33: "La lettre revint avec la mention « introuvable »."}


def test_residue(spark):
    rows = [(i, t, "s") for i, t in (FOUND | PRINTED).items()] + [(101, FOUND[1], "s"), (1, FOUND[1], "s"), (None, FOUND[1], "s")]
    d = docs(spark, rows)
    got = [r["doc_id"] for r in residue.residue_pages(d).collect()]
    assert sorted(got) == sorted([*FOUND, 101])
    assert {r["doc_id"] for r in residue.clean_pages(d.where("doc_id is not null")).collect()} == set(PRINTED)
    assert residue.residue_pages(d.limit(0)).count() == 0


def test_folding_and_hashing():
    assert residue.folded("JavaScript") == residue.folded("Jav0Scripf") and residue.folded("rnaquette") == residue.folded("maquette") and residue.folded("tea 17") == residue.folded("tea 4") != residue.folded("tea")
    assert residue.folded("Reference no. 9b9ac9ff12") == residue.folded("Reference no. 4")
    h = residue.simhashes([residue.folded(t) for t in ("please enable javascript to view this page", "please enable javascript to view thi page", "the parish clerk opened a silver watch")])
    assert _bits(h[0], h[1]) <= residue.HAMMING < _bits(h[0], h[2]) and len(residue.simhashes([])) == 0
    # one by one, by the definition: the sign of each sum over all trigrams
    t = residue.folded("this viewer does not work without scripts")
    c = residue._numbers(t)
    signs = residue._signs().view("uint8").astype(int) * 2 - 1
    sums = sum(signs[(c[i] * 28 + c[i + 1]) * 28 + c[i + 2]] for i in range(len(c) - 2))
    assert [int(b) for x in residue.simhashes([t]).view("uint8")[0] for b in f"{x:08b}"] == [int(x > 0) for x in sums]
    assert residue.repeated("no no no") is None and residue.repeated("blah blah, blah") and residue.repeated("xxxx xx xxx") and residue.repeated("the tar and the tar") is None


def test_nodes_that_are_left_out_can_take_no_label():
    """The count of shared grams keeps every node that is as alike to a trusted wording as a label asks for."""
    rng = random.Random(3)
    texts = []
    for _ in range(400):
        w = list(rng.choice(residue.WORDINGS))
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice("abdgkmpvwz")
        texts.append("".join(w))
    known = [residue.grams(t) for t in residue.catalogue()]
    for t in texts + NEWS.split("\n"):
        f = residue.folded(t)
        text, s, e, _ = residue.spans_of([residue.prepared(t)])
        if len(f) >= residue.LEAST and "\x04" not in residue.prepared(t) and max(residue.dice(residue.grams(f), k) for k in known) >= residue.ROOT_SIMILARITY:
            assert f in {text[a:b] for a, b in zip(s, e)}, t


def _bits(a, b):
    return sum(bin((int(x) ^ int(y)) & (2**64 - 1)).count("1") for x, y in zip(a, b))


def _brute_force(nodes, trusted):
    """The labelled nodes by comparing every pair."""
    of = {n: residue.grams(n) for n in nodes}
    roots = {n: n for n in trusted}
    frontier = dict(roots)
    while frontier:
        fresh = {}
        for n in nodes - set(roots):
            fits = [r for k, r in frontier.items() if residue.dice(of[k], of[n]) >= residue.SIMILARITY and residue.dice(of[r], of[n]) >= residue.ROOT_SIMILARITY]
            if fits:
                fresh[n] = max(fits, key=lambda r: (residue.dice(of[r], of[n]), r))
        roots.update(fresh)
        frontier = fresh
    return set(roots)


def test_tables_find_near_duplicates(spark):
    """Of the pairs at Dice 0.8 or more, at least nine in ten meet in the tables and are within the Hamming distance; of those within 15 bits, all."""
    rng = random.Random(9)
    pairs = []
    while len(pairs) < 1500:
        a = rng.choice(sorted(residue.catalogue()))
        b = list(a)
        for _ in range(rng.randint(1, 3)):
            k = rng.randrange(len(b))
            b[k:k + 1] = rng.choice([[rng.choice("abdglmnopsvwx")], [rng.choice("abdglmnopsvwx")], [], [b[k], rng.choice("abdglmnopsvwx")]])
        if len(b) >= residue.LEAST and a != (b := "".join(b)) and residue.similar(a, b) >= residue.SIMILARITY:
            pairs.append((a, b))
    x, y = (residue.simhashes([p[i] for p in pairs]) for i in (0, 1))
    met = [bool(set((k[:, None] ^ residue._FLIPS).ravel().tolist()) & set(m.tolist())) for k, m in zip(residue.keys(x), residue.keys(y))]
    bits = [_bits(p, q) for p, q in zip(x, y)]
    assert all(m for m, n in zip(met, bits) if n <= 15)
    assert sum(m and n <= residue.HAMMING for m, n in zip(met, bits)) >= 0.9 * len(pairs)


def test_labels_pass_through_components(spark):
    """Of the nodes that comparing all pairs labels, at least nine in ten get their label, and no other node does."""
    rng = random.Random(9)
    rows = []
    for i in range(240):
        w = list(rng.choice(residue.WORDINGS))
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = rng.choice("abdgkmpvwz")
        rows.append((i, "".join(w), "s"))
    nodes, labelled = residue.residue_nodes(docs(spark, rows))
    made = {r["node"] for r in nodes.where("not trusted").collect()}
    got = {r["node"] for r in labelled.collect()}
    known = set(residue.catalogue())
    every = _brute_force(made | known, known) & made
    assert got <= every and len(got) >= 0.9 * len(every) and got - known


def test_long_cells_are_looked_at_whole(spark):
    long = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt ut labore et dolore magna aliqua"
    fused = "the harbour board praised several broken windows Please enable JavaScript to view this page wheat and barley were sold by the quarter at noon"
    rows = [(1, long, "s"), (2, fused, "s"), (3, "Trachack Tracehack (most recent call last)", "s"), (4, "errno 13 was printed", "s"), (5, "served by nginx 1", "s"), (6, NEWS.replace("\n", " ") * 3, "s")]
    assert sorted(r["doc_id"] for r in residue.residue_pages(docs(spark, rows)).collect()) == [1, 2, 3, 4, 5]
