"""Tables that appear at once or not at all: data first, a manifest last.

Each commit of a folder has a key. Its tables are written under a path of their own, and then one small file is renamed into
place that names the path; readers list those files and nothing else. What a writer that died has left behind is never read, and
a commit with the same key takes the place of the one before. reset() begins a new generation, by one rename as well. fold()
gathers many small commits into one, which appears and replaces them by one rename too.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Of a file that fold() writes, about.
FILE_BYTES = 256 << 20


class Commits:
    """The commits of a folder, on any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self._path_of(f"{self.folder}/{name}")

    def _path_of(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _put(self, name: str, text: str) -> None:
        """Writes a small file, all of it or nothing."""
        fs, made, final = self._fs(), self._path(f"_{uuid.uuid4().hex}"), self._path(name)
        out = fs.create(made, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.mkdirs(final.getParent())
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        where = fs.makeQualified(made)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.spark._jsc.hadoopConfiguration()).rename(where, fs.makeQualified(final), options)

    def _get(self, path) -> str:
        stream = self._fs().open(path)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text

    def generation(self) -> str:
        path = self._path("GENERATION")
        return self._get(path) if self._fs().exists(path) else "0"

    def reset(self) -> None:
        """Forgets all commits."""
        self._put("GENERATION", uuid.uuid4().hex)

    def commit(self, key: str, tables: dict[str, DataFrame]) -> None:
        data = f"{self.folder}/data/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{data}/{name}")
        self._put(f"manifests/{self.generation()}/{key}.json", json.dumps({"key": key, "data": data, "tables": sorted(tables)}))

    def fold(self, schemas: dict[str, str], fan: int, last: str) -> None:
        """Gathers commits of one level, `fan` or more that lie before the key `last`, into one commit of the next level; so on up.

        `last` and what comes after it may be written again and stays as it is. The keys that a commit stands for are in its
        manifest, and readers pass over their own manifests from then on, whether or not these were deleted yet.
        """
        while True:
            levels: dict[int, list[dict]] = {}
            for m in self.manifests():
                if m["key"] < last:
                    levels.setdefault(m.get("level", 0), []).append(m)
            level = min((k for k, parts in levels.items() if len(parts) >= fan), default=None)
            if level is None:
                return
            parts = levels[level]
            data, key = f"{self.folder}/data/{uuid.uuid4().hex}", parts[-1]["key"]
            tables = sorted(t for t in schemas if any(t in m["tables"] for m in parts))
            for t in tables:
                rows = self.spark.read.schema(schemas[t]).parquet(*(f"{m['data']}/{t}" for m in parts if t in m["tables"]))
                size = sum(self._fs().getContentSummary(self._path_of(f"{m['data']}/{t}")).getLength() for m in parts if t in m["tables"])
                rows.coalesce(-(-size // FILE_BYTES) or 1).write.parquet(f"{data}/{t}")
            where = f"manifests/{self.generation()}"
            replaced = [f for m in parts for f in (m["file"], *m.get("replaces", ()))]
            self._put(f"{where}/{key}-level{level + 1}.json", json.dumps({"key": key, "data": data, "tables": tables, "level": level + 1, "replaces": replaced}))
            for m in parts:
                self._fs().delete(self._path(f"{where}/{m['file']}"), False)

    def manifests(self) -> list[dict]:
        """What was committed, by key: a small file for each run or batch, or for several that were gathered."""
        where = self._path(f"manifests/{self.generation()}")
        if not self._fs().exists(where):
            return []
        files = [s.getPath() for s in self._fs().listStatus(where) if s.getPath().getName().endswith(".json")]
        found = [json.loads(self._get(f)) | {"file": f.getName()} for f in files]
        gone = {f for m in found for f in m.get("replaces", ())}
        return sorted((m for m in found if m["file"] not in gone), key=lambda m: m["key"])

    def read(self, table: str, schema: str, without: str | None = None) -> DataFrame:
        """The rows of a table in all commits but the one with the key `without`."""
        paths = [f"{m['data']}/{table}" for m in self.manifests() if table in m["tables"] and m["key"] != without]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
