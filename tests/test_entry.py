import subprocess
import sys


def test_entry_imports_without_a_session_and_names_agree():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), len(o))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rpartition("/tests/")[0])
    assert out.returncode == 0, out.stderr[-2000:]


def test_flagship_query(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 50 and "price_category" in df.columns


def test_nothing_outside_llm_imports_it():
    root = __file__.rpartition("/tests/")[0]
    found = subprocess.run(["grep", "-rlE", "bindery[.]llm|from bindery import llm", f"{root}/bindery", "--include=*.py"], capture_output=True, text=True).stdout.split()
    assert all("/bindery/llm/" in f for f in found)
