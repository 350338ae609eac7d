"""A git repository as tables: a Python data source over the git command line.

``spark.read.format("gitrepo").option("path", dir).option("table", name).load()`` with the tables files, commits,
commit_files, renames and text. Blame is a DataFrame operator, as it starts from a list of paths.
"""

from __future__ import annotations

import os
import subprocess
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codequarry.functions import paths as P
from codequarry.functions import text as T

MAX_BYTES = 1_000_000
SCHEMAS = {
    "blobs": "path string, blob_id string, size_bytes long, content binary",
    "commits": "commit_id string, author_email string, author_name string, ts timestamp, n_parents int, files_changed int, seq int",
    "commit_files": "commit_id string, path string, change string, seq int, ord int",
    "renames": "seq int, ord int, old_path string, new_path string",
}


def git(repo: str, *args: str, data: bytes | None = None) -> bytes:
    """Output of a git command; never asks for a password."""
    return subprocess.run(["git", "-C", repo, *args], input=data, check=True, capture_output=True, env=os.environ | {"GIT_TERMINAL_PROMPT": "0", "LC_ALL": "C"}).stdout


def open_local(path: str) -> str:
    """The commit at HEAD; a repository without commits, or none at all, is an error."""
    try:
        return git(path, "rev-parse", "HEAD^{commit}").decode().strip()
    except (subprocess.CalledProcessError, FileNotFoundError, NotADirectoryError) as e:
        raise ValueError(f"no commits found in {path}") from e


class clone:  # noqa: N801
    """Context manager: a bare clone in a new folder below ``folder``, deleted on exit and on failure. On a cluster
    ``folder`` must be one that the executors share, as they read the clone; without it only one machine can."""

    def __init__(self, url: str, timeout: int = 600, folder: str | None = None) -> None:
        self.url, self.timeout, self.folder = url, timeout, folder

    def __enter__(self) -> str:
        self.dir = tempfile.TemporaryDirectory(prefix="clone-", dir=self.folder)
        try:
            subprocess.run(["git", "clone", "--bare", "--quiet", self.url, self.dir.name], check=True, timeout=self.timeout, capture_output=True, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"})
        except BaseException:
            self.dir.cleanup()
            raise
        return self.dir.name

    def __exit__(self, *exc: object) -> None:
        self.dir.cleanup()


class _Slice(InputPartition):
    def __init__(self, i: int, n: int) -> None:
        self.i, self.n = i, n


class GitReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.table = options["path"], options.get("table", "blobs")
        self.most = int(options.get("maxcommits", 10**9))
        self.slices = int(options.get("slices", 8))

    def partitions(self) -> list[InputPartition]:
        if self.table == "blobs":
            return [_Slice(i, self.slices) for i in range(self.slices)]
        # history: runs of commits of even length; finding what a commit changed is the work
        n = min(self.most, int(git(self.path, "rev-list", "--count", "HEAD")))
        each = max(1, -(-n // self.slices))
        return [_Slice(at, min(each, n - at)) for at in range(0, n, each)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        return self._blobs(partition) if self.table == "blobs" else self._history(partition)

    def _blobs(self, part: _Slice) -> Iterator[tuple]:
        listed = git(self.path, "ls-tree", "-r", "-z", "-l", "HEAD").split(b"\0")
        rows = []
        for line in listed[part.i :: part.n]:
            if not line:
                continue
            meta, _, path = line.partition(b"\t")
            mode, kind, blob, size = meta.split()
            if kind != b"blob" or mode == b"120000":  # neither submodules nor symlinks have content of their own
                continue
            rows.append((path.decode("utf-8", "replace"), blob.decode(), int(size)))
        # one object asked for and read at a time: a slice is never held whole
        with subprocess.Popen(["git", "-C", self.path, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as p:
            for path, blob, size in rows:
                content = None
                if size <= MAX_BYTES:
                    p.stdin.write(f"{blob}\n".encode())
                    p.stdin.flush()
                    n = int(p.stdout.readline().split()[2])
                    content = p.stdout.read(n)
                    p.stdout.read(1)
                yield path, blob, size, content
            p.stdin.close()

    def _blocks(self, args: list[str]) -> Iterator[str]:
        """What the log says of each commit, read as it comes."""
        with subprocess.Popen(["git", "-C", self.path, *args], stdout=subprocess.PIPE, env=os.environ | {"LC_ALL": "C"}) as p:
            held = b""
            while piece := p.stdout.read(1 << 16):
                *whole, held = (held + piece).split(b"\x01")
                yield from (x.decode("utf-8", "replace") for x in whole if x)
            if held:
                yield held.decode("utf-8", "replace")
        if p.returncode:
            raise RuntimeError(f"git log failed with {p.returncode}")

    def _history(self, part: _Slice) -> Iterator[tuple]:
        fmt = "%x01%H%x00%aE%x00%aN%x00%at%x00%P%x00"
        args = ["log", "--topo-order", "--name-status", "-M", "-z", "--no-color", f"--skip={part.i}", f"--max-count={part.n}", f"--format={fmt}", "--diff-merges=off", "HEAD"]
        for seq, block in enumerate(self._blocks(args), part.i):
            head = block.split("\x00", 5)
            sha, email, name, at, parents = head[:5]
            items = [x for x in head[5].split("\x00")] if len(head) > 5 else []
            changes, i = [], 0
            items = [x.strip("\n") for x in items]
            while i < len(items):
                code = items[i]
                if not code:
                    i += 1
                elif code[0] in "RC":
                    changes.append((code[0], items[i + 1], items[i + 2]))
                    i += 3
                else:
                    changes.append((code[0], items[i + 1], items[i + 1]))
                    i += 2
            merge = len(parents.split()) > 1
            if self.table == "commits":
                yield sha, email.lower(), name, pd.Timestamp(int(at), unit="s").to_pydatetime(), len(parents.split()), 0 if merge else len(changes), seq
            elif self.table == "renames":
                for o, (code, old, new) in enumerate(changes):
                    if code == "R":
                        yield seq, o, old, new
            elif not merge:
                for o, (code, old, new) in enumerate(changes):
                    yield sha, old if code == "D" else new, code, seq, o


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitrepo"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "blobs")]

    def reader(self, schema: object) -> GitReader:
        return GitReader(dict(self.options))


def read_git(spark: SparkSession, path: str, table: str, **options: object) -> DataFrame:
    """One table of the repository at ``path``: blobs, commits, commit_files or renames."""
    spark.dataSource.register(GitSource)
    r = spark.read.format("gitrepo").option("path", path).option("table", table)
    for k, v in options.items():
        r = r.option(k, str(v))
    return r.load()


def inventory(blobs: DataFrame) -> DataFrame:
    """(path, blob_id, language, size_bytes, is_binary, lines, non_blank_lines, indent_complexity, is_test, skip_reason,
    generated_reason, text): files measured; over 1 MB not read, binary ones without text."""
    p = F.col("path")
    b = blobs.withColumn("is_binary", F.coalesce(T.looks_binary(F.col("content")), F.lit(False))).withColumn("skip_reason", F.when(F.col("size_bytes") > MAX_BYTES, "larger than 1 MB"))
    b = b.withColumn("text", F.when(~F.col("is_binary") & F.col("content").isNotNull(), F.decode("content", "UTF-8"))).withColumn("m", T.line_metrics(F.col("text")))
    zero = lambda c: F.coalesce(F.col(f"m.{c}"), F.lit(0))
    return b.select(
        "path", "blob_id", P.language(p).alias("language"), "size_bytes", "is_binary", zero("lines").alias("lines"), zero("non_blank").alias("non_blank_lines"),
        zero("indent_complexity").alias("indent_complexity"), P.is_test(p).alias("is_test"), "skip_reason", F.coalesce(P.generated_reason(p), T.generated_marker(F.col("text"))).alias("generated_reason"), "text",
    )


def ignored_revisions(text: str, repo: str) -> list[str]:
    """The 40-digit lines of an ignore-revs file whose commits exist."""
    out = []
    for raw in text.splitlines():
        line = raw.split("#")[0].strip()
        if len(line) == 40 and all(c in "0123456789abcdefABCDEF" for c in line):
            try:
                git(repo, "cat-file", "-e", f"{line}^{{commit}}")
                out.append(line.lower())
            except subprocess.CalledProcessError:
                continue
    return list(dict.fromkeys(out))


BLAME = "path string, email string, name string, lines int, last_at timestamp, error string"


def blame(paths: DataFrame, repo: str, *, ignore: list[str] | None = None, tasks: int = 32) -> DataFrame:
    """(path, email, name, lines, last_at, error): lines per author of each path at HEAD, whitespace ignored, renames
    followed. A path that fails gives one row with its error. One git process per path, spread over ``tasks`` tasks."""
    skip = [x for rev in ignore or [] for x in ("--ignore-rev", rev)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                try:
                    out = git(repo, "blame", "-w", "--line-porcelain", *skip, "HEAD", "--", p).decode("utf-8", "replace")
                except subprocess.CalledProcessError as e:
                    rows.append((p, None, None, 0, None, e.stderr.decode("utf-8", "replace").strip()[:500]))
                    continue
                n: dict[str, list] = {}
                mail = name = ""
                at = 0
                for line in out.split("\n"):
                    if line.startswith("author "):
                        name = line[7:]
                    elif line.startswith("author-mail "):
                        mail = line[12:].strip("<>").lower()
                    elif line.startswith("author-time "):
                        at = int(line[12:])
                    elif line.startswith("\t"):
                        e = n.setdefault(mail, [name, 0, 0])
                        e[1] += 1
                        if at >= e[2]:
                            e[0], e[2] = name, at
                rows += [(p, m, v[0], v[1], pd.Timestamp(v[2], unit="s"), None) for m, v in n.items()]
            yield pd.DataFrame(rows, columns=["path", "email", "name", "lines", "last_at", "error"])

    return paths.select("path").repartition(tasks).mapInPandas(run, BLAME)
