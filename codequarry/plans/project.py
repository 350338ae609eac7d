"""The files of the tables, and beside them a small Python project built anew in every repository of ``files``.

All repositories get modules of the same names, so an import, a finding or an edge that crossed from one repository into
another would show at once; what has to come out in each is known and stands in the SQL. Repositories whose name has an
odd number of letters get one module more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import paths as P
from codequarry.functions import text as T
from codequarry.session import table
from codequarry.sources import pyast

_BODY = "".join(f"    {v} = load_{v}({v}_source)\n" for v in ("alpha", "beta", "gamma", "delta", "omega", "sigma"))
_TWIN = "".join(f"register_handler('{v}', handle_{v})\n" for v in ("open", "close", "read", "write", "seek", "flush", "lock", "unlock", "stat", "sync", "move", "copy"))
#: path -> text of the project; the last one only where the repository's name is odd.
FILES = {
    "zapp/__init__.py": "",
    "zapp/models.py": "import os\n\n\nclass Item:\n    def total(self):\n        return 1\n",
    "zapp/util.py": f"from . import models\n\n\ndef prepare(x):\n{_BODY}    return x\n",
    "zapp/again.py": f"import zapp.util\n\n\ndef arrange(y):\n{_BODY}    return x\n",
    "zapp/core/__init__.py": "",
    "zapp/core/engine.py": "import numpy\nfrom zapp.store import disk\nfrom zapp import models, again\n",
    "zapp/store/__init__.py": "",
    "zapp/store/disk.py": "import sys\n\nfrom zapp.core import engine\nfrom zapp.core.engine import run\n",
    "zapp/store/models.py": "from zapp.store import disk\n\n\nclass Row:\n    pass\n",
    "zlib9/loose.py": "VALUE = 1\n",
    "zlib9/big.py": "import zlib9.loose\n" + "v = 1\n" * 320,
    "zlib9/twin_a.py": _TWIN,
    "zlib9/twin_b.py": _TWIN + "extra = 1\n",
    "zextra/helper.py": "def help_me():\n    return 0\n",
    "zextra/ledgerbox.py": "",
    "zapp/ledgerbox.py": "",
    "zlib9/ledgerbox.py": "",
    "run_z.py": "import zapp.core.engine, zapp.store.models\n\nif __name__ == '__main__':\n    pass\n",
    "tests/test_zmodels.py": "from zapp.models import Item\nimport zextra.helper\n",
    "zapp/odd.py": "import zapp.util as u, zapp.missing\n",
}
#: (source, target, first line) of what the imports above mean.
EDGES = [
    ("zapp/util.py", "zapp/models.py", 1), ("zapp/again.py", "zapp/util.py", 1), ("zapp/core/engine.py", "zapp/store/disk.py", 2), ("zapp/core/engine.py", "zapp/models.py", 3), ("zapp/core/engine.py", "zapp/again.py", 3),
    ("zapp/store/disk.py", "zapp/core/engine.py", 3), ("zapp/store/models.py", "zapp/store/disk.py", 1), ("zlib9/big.py", "zlib9/loose.py", 1), ("run_z.py", "zapp/core/engine.py", 1), ("run_z.py", "zapp/store/models.py", 1),
    ("tests/test_zmodels.py", "zapp/models.py", 1), ("tests/test_zmodels.py", "zextra/helper.py", 2), ("zapp/odd.py", "zapp/util.py", 1), ("zapp/odd.py", "zapp/__init__.py", 1),
]
ODD = "zapp/odd.py"


def project(spark: SparkSession, base: str) -> DataFrame:
    """(repo, path, text): the project of every repository."""
    rows = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(t).alias("text")) for p, t in FILES.items()))
    repos = table(spark, base, "files").select("repo").dropna().distinct()
    return repos.select("repo", F.explode(rows).alias("x")).select("repo", "x.*").filter((F.col("path") != ODD) | (F.length("repo") % 2 == 1))


def texts(spark: SparkSession, base: str) -> DataFrame:
    """(repo, path, text) of all files with a text, those of the project included."""
    return table(spark, base, "file_text").select("repo", "path", "text").unionByName(project(spark, base))


def files(spark: SparkSession, base: str) -> DataFrame:
    """The table ``files``, as far as findings read it, and the files of the project."""
    cols = ["repo", "path", "language", "is_binary", "lines", "non_blank_lines", "is_test", "skip_reason", "generated_reason"]
    p = project(spark, base).withColumn("m", T.line_metrics(F.col("text")))
    none = F.lit(None).cast("string")
    own = p.select("repo", "path", P.language(F.col("path")).alias("language"), F.lit(False).alias("is_binary"), F.col("m.lines").cast("int").alias("lines"), F.col("m.non_blank").cast("int").alias("non_blank_lines"), P.is_test(F.col("path")).alias("is_test"), none.alias("skip_reason"), none.alias("generated_reason"))
    return table(spark, base, "files").select(*cols).unionByName(own)


def parsed(spark: SparkSession, base: str) -> DataFrame:
    """Imports and symbols of all Python files."""
    return pyast.parse_files(texts(spark, base).filter(F.col("path").endswith(".py")), repo="repo")


def files_sql() -> str:
    """The project in SQL, pf: repo, path, language, lines, is_test, guarded (by a check for the main module)."""
    rows = [(p, "python", t.count("\n"), p.startswith("tests/"), "__main__" in t) for p, t in FILES.items()]
    return f"pf AS ({sql([r for r in rows if r[0] != ODD], 'path, language, lines, is_test, guarded', [r for r in rows if r[0] == ODD])})"


def sql(rows: list[tuple], cols: str, odd: list[tuple] = ()) -> str:
    """(repo, cols): rows that must come out in every repository, and those only where its name is odd."""
    from codequarry.plans.registry import values_sql

    tagged = [(*r, False) for r in rows] + [(*r, True) for r in odd]
    return f"SELECT repo, {cols} FROM (SELECT DISTINCT repo FROM files WHERE repo IS NOT NULL) JOIN ({values_sql(tagged, cols + ', only_odd')}) ON NOT only_odd OR length(repo) % 2 = 1"
