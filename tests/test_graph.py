import random

from loomindex.operators import graph
from tests.helpers import rows, symbols


def test_containers_equal_brute_force(spark):
    rng = random.Random(4)
    spans = []
    for i in range(250):
        a = rng.randrange(1, 400)
        b = a + rng.choice((0, 0, 1, 3, 7, 8, 31, 64, 200))
        spans.append({"id": i, "path": f"f{rng.randrange(2)}", "kind": rng.choice(("function", "class", "import")), "start_line": a, "start_column": rng.randrange(1, 4), "end_line": b, "end_column": rng.randrange(4, 9)})
    spans += [{"id": 900, "path": None}, {"id": 901, "path": "f0", "start_line": None, "end_line": None}]

    def inside(x, y):
        return y["path"] == x["path"] and y["id"] != x["id"] and y["kind"] != "import" and (y["start_line"], y["start_column"]) <= (x["start_line"], x["start_column"]) and (y["end_line"], y["end_column"]) >= (x["end_line"], x["end_column"])

    want = []
    for x in spans[:250]:
        around = sorted((y for y in spans[:250] if inside(x, y)), key=lambda y: ((y["end_line"] - y["start_line"]) * 1000 + y["end_column"] - y["start_column"], y["start_line"], y["id"]))
        want += [(x["id"], y["id"], place) for place, y in enumerate(around[:3], 1)]
    got = rows(graph.containers(symbols(spark, spans)))
    assert got == sorted(want) and len(got) > 100
    assert graph.containers(symbols(spark, spans).limit(0)).count() == 0
