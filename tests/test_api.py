import pytest

from codeloom.plans import patterns
from codeloom.plans.api import Repo
from codeloom.streaming import incremental

FILES = {
    "lib/queue.py": "class Queue:\n    def push(self, item):\n        self.items.append(item)\n\ndef make_queue():\n    return Queue()\n",
    "app.py": "from lib.queue import Queue\n\ndef main():\n    q = Queue()\n    q.push(1)  # Queue again\n",
    "other.go": "package other\n\nfunc Queue() int {\n  return 1\n}\n",
}


@pytest.fixture(scope="module")
def repo(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for p, t in FILES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    return Repo.of_tree(spark, str(root))


def test_queries(repo):
    assert [r.path for r in repo.files("queue").collect()] == ["app.py", "lib/queue.py", "other.go"]
    assert [r.path for r in repo.files("Queue[(]").collect()] == [] and [r.path for r in repo.files("append|package").collect()] == ["lib/queue.py", "other.go"]
    assert [(r.importer, r.imported) for r in repo.edges.collect()] == [("app.py", "lib/queue.py")]
    top = repo.focus("Queue").orderBy("rank").first()
    assert (top.path, top.kind, top.start_line, top.end_line) == ("lib/queue.py", "class", 1, 3)
    assert repo.focus("makeQueue").first().name == "make_queue"
    assert "line" in repo.focus("items.append").columns
    assert {r.sym_id for r in repo.callers("Queue").collect()} == {"lib/queue.py#2", "app.py#0"}
    assert ("lib/queue.py", "push") in {(r.path, r.name) for r in repo.callees("main").collect()}
    assert [r.name for r in repo.similar("mak_queue").collect()][:1] == ["make_queue"]
    assert repo.orient(budget=200).count() >= 4
    new = {r.path: r.content for r in repo.rename("Queue", "Line", text_only=True).collect()}
    assert new == {p: patterns.re.sub(r"\bQueue\b", "Line", t) for p, t in FILES.items()}
    assert repo.usages("Queue").count() == 6


def test_rename_keeps_to_the_declaration(repo):
    with pytest.raises(ValueError):
        repo.rename("Queue", "Line")
    new = {r.path: r.content for r in repo.rename("Queue", "Line", path="lib/queue.py").collect()}
    assert new == {"lib/queue.py": FILES["lib/queue.py"].replace("Queue", "Line"), "app.py": FILES["app.py"].replace("Queue\n", "Line\n").replace("Queue()", "Line()")}
    found = {(r.path, r.line, r.binding) for r in repo.references("Queue", "lib/queue.py").collect()}
    assert found == {("lib/queue.py", 6, "resolved"), ("app.py", 4, "resolved")}
    after = repo.insert_after("lib/queue.py", "make_queue", "x = 1").first().content
    assert after.endswith("return Queue()\nx = 1\n")
    assert repo.replace("app.py", "q.push(1)", "q.push(2)", symbol="main").first().n == 1
    assert repo.replace("app.py", "q.push(1)  # Queue agian", "z").first().why == "alike"


def test_patch_of_a_stream_equals_rebuild(spark, tmp_path):
    schema = "path string, content string"
    held = {"t": spark.createDataFrame([("a", "one"), ("b", "two")], schema)}
    spark.createDataFrame([("b", "three"), ("c", "four")], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def write(df):
        held["t"] = spark.createDataFrame(df.collect(), schema)

    q = incremental.reconcile_stream(stream, lambda b: b, lambda: held["t"], write).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, held["t"].collect())) == [("a", "one"), ("b", "three"), ("c", "four")]
