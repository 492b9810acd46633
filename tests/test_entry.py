import subprocess
import sys

import __spark_entry__ as entry
from codeloom.plans import catalog


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(catalog.QUERIES) <= set(queries) and set(sql) <= set(queries)
    assert entry.entry(spark).columns == ["path"]


def test_library_does_not_need_the_subpackage(tmp_path):
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "codeloom.llm" or name.startswith("codeloom.llm.") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e, codeloom.plans.api, codeloom.streaming.incremental
assert len(e.queries()) > 100 and not any(k.startswith("op") for k in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0])


def test_a_missing_library_is_no_reason_to_drop_queries():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "public_tokenizers":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
try:
    import __spark_entry__
except ModuleNotFoundError as e:
    assert e.name == "public_tokenizers"
else:
    raise SystemExit(1)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0])
