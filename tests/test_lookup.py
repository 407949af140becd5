"""Assemblies by name, JSON as it is written, and the entry without the training-data queries."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from textfacts.functions import text as X
from textfacts.operators import graph

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _plain(wanted, rows):
    seen, own = set(), []
    for path, n in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1], r[0])):
        if path.lower() not in seen:
            seen.add(path.lower())
            own.append((path, n))
    out = {}
    for w in {w for w in wanted if w}:
        name = lambda p: p.replace("\\", "/").split("/")[-1].lower()
        hit = next(((p, n, 0) for p, n in own if name(p).rpartition(".")[0] == w.lower() or "." not in name(p) and name(p) == w.lower()), None)
        hit = hit or next(((p, n, 1) for p, n in own if w.lower() in name(p)), None)
        if hit:
            out[w] = hit
    return out


def test_assemblies_by_plain_search(spark):
    paths = ["lib/System.Text.dll", "LIB/system.text.DLL", "ref/System.dll", "c:\\x\\Mono.Cecil.dll", "lib/a.dll", "lib/Äö.dll", "noext", None, "lib/System.Text.Json.dll", "x/aaa.dll"]
    rows = [(p, n) for n, p in enumerate(paths)] + [("x/aaa.dll", 3)] + [(f"g/Common{i}.dll", 100 + i) for i in range(300)]
    wanted = ["system", "SYSTEM.TEXT", "text", "json", "cecil.d", "a", "aa", "ö", "nope", "", None, "Common", "common299", "noext", "m", "l.d", "system", "x", "ommon7."]
    got = graph.resolved(spark.createDataFrame([(w, 1) for w in wanted], "want string, path int"), spark.createDataFrame([(p, n, "z") for p, n in rows], "path string, place int, want string"), "want", "path", "place")
    assert {r["want"]: (r["path"], r["place"], r["rank"]) for r in got.collect()} == _plain(wanted, rows)
    assert graph.resolved(got.select("want").where("false"), spark.createDataFrame(rows, "path string, place int"), "want", "path", "place").count() == 0


@pytest.mark.parametrize("value", [{"a b": ["é", "<&>'+`\"", "\\ /", "\n\t\x01\x7f", "😀𝒳"], "": {}}, [], "x", ["\u2028\ufeff"], {"k": [1.5, None, True, " { } "]}])
def test_json_is_written_with_escapes(spark, value):
    text = json.dumps(value, ensure_ascii=False, indent=2)
    got = spark.createDataFrame([(text,)], "t string").select(X.json_compact(F.col("t"))).first()[0]
    assert json.loads(got) == value and got.isascii() and not set(got) & set("<>&'+`\n")
    assert got == spark.createDataFrame([(json.dumps(value),)], "t string").select(X.json_compact(F.col("t"))).first()[0]


@pytest.mark.parametrize("missing", ["textfacts.llm", "corpus_pipeline", "tokenizers", "xxhash"])
def test_entry_without_the_training_data_queries(missing):
    code = f"""
import sys, warnings
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r} or name.startswith({missing!r} + "."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Gone())
with warnings.catch_warnings(record=True) as told:
    warnings.simplefilter("always")
    import __spark_entry__ as e
print(len(e.queries()) == len(e.oracle_sql()) > 60, any({missing!r} in str(w.message) for w in told))
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    # Named where it is missing; the pipeline and the subpackage may be absent, and then nothing of theirs is.
    told = missing in ("tokenizers", "xxhash") and os.path.exists(os.path.join(REPO, "corpus_pipeline.py"))
    assert out.stdout.split() in [["True", str(told)]] + [["False", "False"]] * told  # or nothing imports it at once
