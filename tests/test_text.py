from pyspark.sql import functions as F

from tarnlight.functions import text as T
from tarnlight.functions.porter import stem
from tarnlight.operators.dialog import parsed_turns


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_normalize_phrase(spark):
    for given, wanted in (("Éclair--Crème  42", "clair cr me 42"), ("", ""), (" A.b ", "a b")):
        assert one(spark, T.normalize_phrase(F.col("t")), t=given) == wanted


def test_breadcrumbs(spark):
    tail = lambda *c: one(spark, T.breadcrumb_tail(F.array(*(F.lit(x) for x in c)).cast("array<string>")))
    assert tail("Clothing, Shoes & Jewelry", "Rings") == "Shoes & Jewelry Rings"
    assert tail() == "clothing item" and tail("Clothing") == "clothing item"


def test_classify_and_budget(spark):
    def kind(p):
        a, v = T.classify_phrase(F.col("p"))
        return tuple(one(spark, F.struct(a.alias("a"), v.alias("v")), p=p))

    assert kind("Material: alloy") == ("material", "alloy")
    assert kind("Outfit: cosy") == ("style", "cosy")
    assert kind("Maker: silk") == ("material", "silk")
    assert kind("under $30")[0] == "budget" and kind("soft and warm")[0] == "feature"
    assert [one(spark, T.budget_max(F.col("p")), p=p) for p in ("about $12.50", "budget is 40", "27.99", "none")] == [12.5, 40.0, 27.99, None]


def test_bare_and_cues(spark):
    def bare(p):
        return tuple(one(spark, F.struct(*T.bare_attribute(F.col("p"))), p=p))

    assert bare("Cotton") == ("material", "cotton") and bare("colour: Grey") == ("color", "grey")
    assert bare("fabric: red") == (None, None) and bare("red dress") == (None, None)
    assert one(spark, T.no_preference(F.col("p")), p="I don't have a preference for size, really") == "size"
    assert one(spark, T.no_preference(F.col("p")), p="don't have an additional preference for zips") == "other"


def test_parse_turn(spark):
    said = lambda m: parsed_turns(spark.createDataFrame([(m,)], "message string"))
    parse = lambda m: said(m).first()["parsed"]
    a = parse("I'm looking for Wrist Watches. A key requirement is: steel band.")
    assert a["category"] == "Wrist Watches" and a["phrases"] == ["steel band"] and not a["is_override"]
    b = parse("I'm looking for Shoes, but I'm still exploring.")
    assert b["category"] == "Shoes" and b["phrases"] == []
    c = parse("Actually, ignore my earlier preference. What I need is: leather.")
    assert c["is_override"] and c["phrases"] == ["leather"]
    d = parse("For that, what matters is: hand wash; hang dry.")
    assert d["phrases"] == ["hand wash; hang dry", "hand wash", "hang dry"]
    e = parse("I don't have a preference for color; please use your judgment.")
    assert e["no_preference_for"] == "color" and e["is_deflection"] and e["phrases"] == []
    assert parse("Those are not quite right yet.")["is_unclear"] and parse(None)["phrases"] == []


def test_requirement_classes(spark):
    assert [one(spark, T.constraint_class(F.col("p")), p=p) for p in ("<= 20", "width 3", "fit", "red")] == ["budget", "size", "style", "color"]
    assert one(spark, T.clean_constraint(F.col("p"), 5), p=" - abc  defgh;") == "abc d"


def test_stem():
    words = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "triplicate": "triplic", "adoption": "adopt", "controll": "control", "sky": "sky"}
    assert {w: stem(w) for w in words} == words
