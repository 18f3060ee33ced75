"""Bodies, roles and cross-checks on small texts."""

from coppice.operators import facts

CODE = """import os

class A:
    def one(self):
        x = 1

        return x

    async def two(self):
        pass
# end
def three(): pass
"""


def test_bodies(spark):
    texts = spark.createDataFrame([("a.py", CODE), ("b.py", None), ("c.py", "")], "path string, content string")
    got = {r["name"]: (r["first_line"], r["last_line"]) for r in facts.bodies(texts).collect()}
    assert got == {"A": (3, 10), "one": (4, 8), "two": (9, 10), "three": (12, 12)}


def test_roles_and_shape(spark):
    text = "import run\ndef run(): pass\n# run it\nrun()\nx = 'please run'\nrun = 2\nrunner\nobj.run\nrun"
    texts = spark.createDataFrame([("a.py", text), ("b.py", None)], "path string, content string")
    roles = facts.occurrence_roles(texts, "run")
    assert [r["role"] for r in roles.orderBy("line").collect()] == ["import", "definition", "comment", "call", "string", "write", "attribute", "reference"]
    assert facts.occurrence_shape(roles).first()["shape"] == "single_writer"
    assert facts.occurrence_shape(roles.limit(0)).first()["shape"] == "unknown"


def test_cross_check_leaves_out_the_defining_file(spark):
    texts = spark.createDataFrame([("a.py", "foo foo bar"), ("b.py", "foo baz_1"), ("c.py", None)], "path string, content string")
    names = spark.createDataFrame([("foo", "a.py"), ("bar", "a.py"), ("none", "b.py"), ("baz_1", None)], "name string, path string")
    got = {r["name"]: (r["hits"], r["files"]) for r in facts.cross_check(names, texts).collect()}
    assert got == {"foo": (1, 1), "bar": (0, 0), "none": (0, 0), "baz_1": (1, 1)}
