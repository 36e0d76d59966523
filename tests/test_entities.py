"""Names, organisations and places in small scenes."""

from gristmill.functions.phonetic import name_key, word_key
from gristmill.operators import entities as E


def test_phonetic_keys():
    assert word_key("smith") == word_key("smyth") and word_key("philip") == word_key("filip")
    assert word_key("catherine") == word_key("katherine") and word_key("knight") == word_key("night")
    assert name_key("john smith") == name_key("smith john") != name_key("john brown")
    assert word_key("") == ""


def names(spark, values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def test_names(spark):
    given = ["John Smith"] * 3 + ["Dr John Smith", "Smith, John", "Jon Smyth", "JohnSmith", "Bill Clark", "William Clark", "William Clark", "Zoë Marl", "Zoe Marl", "Zoe Marl", "Ann Other", None, "123"]
    nick = {word_key("bill"): {word_key("william")}}
    got = {r.name: r.preferred for r in E.dedup_names(names(spark, given), nicknames=nick).collect()}
    assert {got[n] for n in ("John Smith", "Dr John Smith", "Smith, John", "Jon Smyth", "JohnSmith")} == {"John Smith"}
    assert got["Bill Clark"] == "William Clark" == got["William Clark"]
    assert got["Zoë Marl"] == "Zoe Marl" and got["Ann Other"] == "Ann Other" and got["123"] == "123" and None not in got


def test_organisations(spark):
    given = ["World Trade Forum"] * 2 + ["WTF", "World Trade Forum Inc", "Acme", "ACME Ltd", "ACME Ltd"]
    got = {r.name: r.preferred for r in E.dedup_organisations(names(spark, given)).collect()}
    assert got["WTF"] == got["World Trade Forum Inc"] == "World Trade Forum"
    assert got["Acme"] == got["ACME Ltd"] == "ACME Ltd"


def test_context(spark):
    rows = [(1, "Smith"), (1, "John Smith"), (2, "Smith"), (2, "John Smith"), (2, "Ann Smith"), (3, "Lee"), (3, "Bob Lee"), (4, None)]
    got = {(r.doc_id, r.name): r.preferred for r in E.context_dedup(spark.createDataFrame(rows, "doc_id long, name string")).collect()}
    assert got[1, "Smith"] == "John Smith"
    assert got[2, "Smith"] == "Smith"  # three names share the word
    assert got[3, "Lee"] == "Lee"  # too short
    assert len(got) == 7


GAZETTEER = [
    (1, "Freedonia", None, "FD", "", "PCLI", 9000, ["Europe/Fred"]),
    (2, "Sylvania", None, "SY", "", "PCLI", 8000, ["Asia/Syl"]),
    (3, "Springfield", ["Spring Field"], "FD", "North", "PPLA2", 100, ["Europe/Fred"]),
    (4, "Springfield", None, "SY", "East", "PPLA2", 500, ["Asia/Syl"]),
    (5, "North", None, "FD", "North", "ADM1", 400, ["Europe/Fred"]),
    (6, "Springfield", None, "FD", "South", "PPLA2", 300, ["Europe/Fred"]),
    (7, "Nowhere", None, "SY", "East", "HTL", 1, ["Asia/Syl"]),
]


def gazetteer(spark):
    return spark.createDataFrame(GAZETTEER, "geo_id long, name string, names array<string>, country string, admin string, feature string, population long, timezone array<string>")


def test_geo_best(spark):
    got = {r.name: r.geo_id for r in E.geo_best(spark.createDataFrame([("SPRINGFIELD",), ("Spring-Field",), ("Nowhere",), (None,)], "place string"), gazetteer(spark)).collect()}
    assert got == {"SPRINGFIELD": 4, "Spring-Field": 3}


def test_geo_in_context(spark):
    rows = [(1, "Springfield"), (1, "Freedonia"), (2, "Springfield"), (2, "Sylvania"), (3, "Springfield"), (4, "Springfield"), (4, "Freedonia"), (4, "North")]
    got = {(r.doc_id, r.name): r.geo_id for r in E.geo_in_context(spark.createDataFrame(rows, "doc_id long, place string"), gazetteer(spark)).collect()}
    assert got[1, "Springfield"] == 6 and got[2, "Springfield"] == 4 and got[3, "Springfield"] == 4 and got[4, "Springfield"] == 3


def test_recognise_and_merge(spark):
    docs = spark.createDataFrame([(1, "Yesterday Mary Jones met the Acme Corp in Paris."), (2, "nothing"), (3, None)], "doc_id long, text string")
    found = E.recognise(docs, "doc_id", "text", ["Mary"], ["Paris"])
    assert sorted((r.entity, r.kind) for r in found.collect()) == [("Acme Corp", "organization"), ("Mary Jones", "person"), ("Paris", "location")]
    merged = {r.doc_id: (r.person, r.organization, r.location) for r in E.merge_entities(docs, "doc_id", found).collect()}
    assert merged[1] == (["Mary Jones"], ["Acme Corp"], ["Paris"]) and merged[2] == ([], [], [])


def test_state(spark):
    states = spark.createDataFrame([("NY", "york"), ("TX", "texas")], "code string, name string")
    df = spark.createDataFrame([(1, "Austin, Texas"), (2, "nowhere"), (3, "NY or TX"), (4, None)], "id long, place string")
    assert {r.id: r.state for r in E.state_of(df, "id", "place", states).collect()} == {1: "TX", 3: "NY"}


def test_geo_in_context_against_brute_force(spark):
    """Repeated places, nulls, states with one and with several witnesses; no window over a document's candidates."""
    import random

    draw = random.Random(5)
    pick = draw.choice
    places = [
        (pick([*range(1, 60), None]), pick("ABCDEF"), pick([None, ["A"], ["F", "b"]]), pick(["X", "Y", "Z", None]), pick(["p", "q", None]), pick(["PCLI", "ADM1", "PPL", "PPLA", "HTL"]), pick([None, 1, 2, 50]), pick([None, ["Europe/X"], ["Asia/Y"]]))
        for _ in range(150)
    ]
    gazetteer = spark.createDataFrame(places, "geo_id long, name string, names array<string>, country string, admin string, feature string, population long, timezone array<string>")
    mentions = [(d, pick([*"ABCDEFab", None, "nowhere"])) for d in range(25) for _ in range(draw.randrange(1, 5))]
    made = E.geo_in_context(spark.createDataFrame(mentions, "doc_id long, place string"), gazetteer)
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()
    low = lambda x: (x is not None, x if x is not None else 0)
    want = set()
    for d in range(25):
        met = {(n, p) for e, n in mentions if e == d and n for p in range(len(places)) if places[p][5] in E.FEATURES and n.lower() in {x.lower() for x in (places[p][1], *(places[p][2] or []))}}
        of = [places[p] for _, p in met]
        kind = lambda g: E.FEATURES[g[5]][1]
        zone = lambda g: g[7][0].split("/")[0] if g[7] else None
        countries, zones = {g[3] for g in of if kind(g) == "country"} - {None}, {zone(g) for g in of if kind(g) == "country"} - {None}
        states = {(g[3], g[4], g[0]) for g in of if kind(g) == "state" and None not in (g[3], g[4], g[0])}

        def order(g):
            far = None if g[3] is None and zone(g) not in zones else not (g[3] in countries or zone(g) in zones)
            near = g[0] is not None and any((c, s) == (g[3], g[4]) and i != g[0] for c, s, i in states)
            return low(far), not near, E.FEATURES[g[5]][0], -(g[6] or 0), low(g[0]), g[1], (g[3] is not None, g[3] or ""), (g[4] is not None, g[4] or "")

        for n in {n for n, _ in met}:
            g = min((places[p] for m, p in met if m == n), key=order)
            want.add((d, n, g[0], g[1], g[3], g[4]))
    rows = [tuple(r) for r in made.collect()]
    assert len(rows) == len(want) > 30 and set(rows) == want
