"""Contact resolution against a plain search over every crew."""

import random

from siteloom.operators.lookups import with_contact_phone
from tests.helpers import make_tables


def find(name, crews):
    if not name:
        return ""
    active = [c for c in sorted(crews, key=lambda c: c["id"]) if c["attivo"] == 1]
    for test in (lambda n: n == name.lower(), lambda n: name.lower() in n):
        for crew in active:
            if crew["nome"] is not None and test(crew["nome"].lower()):
                return crew["telefono"] or ""
    return ""


def check(spark, crews, names):
    t = make_tables(spark, artigiani=crews)
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id bigint, nome_cercato string")
    got = {r.id: r.telefono for r in with_contact_phone(rows, t.artigiani, "nome_cercato").collect()}
    assert got == {i: find(n, crews) for i, n in enumerate(names)}


def test_rules(spark):
    crews = [
        {"id": 1, "nome": "Mario Rossi", "telefono": "1", "attivo": 0},
        {"id": 2, "nome": "Anna Rossi", "telefono": "2", "attivo": 1},
        {"id": 3, "nome": "rossi", "telefono": "3", "attivo": 1},
        {"id": 4, "nome": "Bianchi", "telefono": None, "attivo": 1},
        {"id": 5, "nome": "Bianchi Carlo", "telefono": "5", "attivo": 1},
        {"id": 6, "nome": None, "telefono": "6", "attivo": 1},
        {"id": 7, "nome": "", "telefono": "7", "attivo": 1},
        {"id": 8, "nome": "Élise à côté", "telefono": "8", "attivo": 1},
    ]
    check(spark, crews, ["ROSSI", "ross", "bianchi", "bianchi c", "mario", "", None, "nobody", " ", "ÉLISE", "côté", "a" * 50])


def test_random_names(spark):
    rng = random.Random(3)

    def word(low, high):
        return "".join(rng.choice("abAB ") for _ in range(rng.randint(low, high)))

    crews = [{"id": i, "nome": word(0, 9), "telefono": rng.choice([None, str(i)]), "attivo": rng.randint(0, 1)} for i in range(60)]
    # one name is wanted by a third of the rows
    check(spark, crews, [word(0, 6) for _ in range(200)] + ["ab"] * 100)


def test_no_crews(spark):
    check(spark, [], ["a", None])


def test_names_by_their_grams(spark):
    """Names that share their rarest gram, hold it at its end, twice, or not at all; longer and shorter than a gram."""
    crews = [{"id": i, "nome": n, "telefono": str(i), "attivo": 1} for i, n in enumerate(["Mario Rossi", "Maria Rossini", "aaaaaa", "ab", "x", "Rossi", "日本の大工", "mar"])]
    names = ["rossi", "ross", "rossin", "o ros", "mar", "maria", "ario r", "aaa", "aaaa", "aaaaaaa", "ab", "b", "x", "日本", "日本の", "の大工", "大", "zzz", "rossx", "mario rossi ", "ri"]
    check(spark, crews, names)


def test_random_long_names(spark):
    rng = random.Random(8)

    def word(low, high, letters="abc "):
        return "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))

    crews = [{"id": i, "nome": word(0, 25), "telefono": str(i), "attivo": rng.randint(0, 3) and 1} for i in range(150)]
    held = [c["nome"][a : a + rng.randint(1, 12)] for c in crews for a in [rng.randint(0, 10)]]
    check(spark, crews, held + [word(2, 8) for _ in range(150)])


def test_wanted_names_are_computed_once(spark):
    """The rows that names come from are read for the names and for the result, not once more for each step."""
    t = make_tables(spark, artigiani=[{"id": 1, "nome": "Mario Rossi", "telefono": "1", "attivo": 1}])
    seen = spark.sparkContext.accumulator(0)
    names = spark.sparkContext.parallelize([(1, "rossi"), (2, "ma")], 1).map(lambda r: seen.add(1) or r).toDF("id bigint, nome_cercato string")
    assert with_contact_phone(names, t.artigiani, "nome_cercato").count() == 2
    assert seen.value <= 4
