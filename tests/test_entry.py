import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith('papyra.llm') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 150 and set(e.oracle_sql()) <= set(e.queries())
assert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']
"""


def test_without_corpus_operators():
    subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, check=True, timeout=120)


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark)
    assert rows.columns == ["doc_id", "pos", "score"] and rows.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
