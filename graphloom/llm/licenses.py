"""Licences of files, by TF-IDF cosine to templates and inheritance from directories.

Passages of a text around a licence word are compared with header templates, and whole texts with full
licence texts, all as sparse TF-IDF vectors over word unigrams and bigrams. A licence file is a text that is
similar to a full text, or has a header and the name of a licence file; a short text with a header speaks for itself alone. A file
that says nothing takes the licence of the nearest ancestor directory that has a licence file:
its path is exploded into ancestors, which are joined with the directories of such files.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, ship

#: How licences are commonly named in headers.
TEMPLATES = {
    "AGPL-3.0": ["licensed under the gnu affero general public license version 3", "spdx license identifier agpl 3 0"],
    "Apache-2.0": ["licensed under the apache license version 2 0", "released under the apache license 2 0", "spdx license identifier apache 2 0"],
    "BSD-2-Clause": ["licensed under the bsd 2 clause license", "released under the simplified bsd license", "spdx license identifier bsd 2 clause"],
    "BSD-3-Clause": ["licensed under the bsd 3 clause license", "redistribution and use in source and binary forms with or without modification are permitted", "spdx license identifier bsd 3 clause"],
    "CC-BY-4.0": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "CC-BY-NC-4.0": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-SA-4.0": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "CC0-1.0": ["released under cc0 1 0 universal public domain dedication", "spdx license identifier cc0 1 0"],
    "GPL-2.0": ["licensed under the gnu general public license version 2", "this work is licensed under the gnu general public license version 2", "spdx license identifier gpl 2 0"],
    "GPL-3.0": ["licensed under the gnu general public license version 3", "this work is licensed under the gnu general public license version 3", "spdx license identifier gpl 3 0"],
    "LGPL-3.0": ["licensed under the gnu lesser general public license version 3", "spdx license identifier lgpl 3 0"],
    "MIT": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "spdx license identifier mit"],
    "MPL-2.0": ["subject to the terms of the mozilla public license version 2 0", "licensed under the mozilla public license 2 0"],
}
#: Full texts by licence. That of AGPL-3.0 is that of GPL-3.0 with the name changed, that of BSD-2-Clause that of BSD-3-Clause without the third clause.
FULL = {f.name.removesuffix(".txt"): f.read_text() for f in sorted((Path(__file__).parent / "texts").glob("*.txt"))}
THRESHOLD = 0.6
#: Cosine of a whole text to a full licence text from which on it is a licence file.
FULL_THRESHOLD = 0.8
_FILE_NAME = re.compile(r"(?:^|/)(?:licen[cs]e|copying|unlicense)(?:[._-][^/]*)?$", re.IGNORECASE)
#: Words of a passage before and after the licence word.
REACH = 14
_WORD = re.compile(r"[^\W_]+")
_CUE = re.compile(r"licen[cs]|spdx|redistribut|hereby granted|\bcc[ -]?(?:by|0)")
#: Every cue holds one of these, and they are found faster than a pattern is.
_HINTS = ("licen", "spdx", "redistribut", "hereby granted", "ccby", "cc by", "cc-by", "cc0", "cc 0", "cc-0")
#: Passages whose best template a task remembers; it starts afresh beyond that.
TABLE = 100_000


def terms(words: list[str]) -> Counter:
    return Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))


class Vectors:
    """Unit TF-IDF vectors of named texts, by term."""

    def __init__(self, rows: list[tuple[str, Counter]]):
        self.rows, self.post = rows, {}
        df = Counter(t for _, v in rows for t in v)
        self.idf = {t: math.log((1 + len(rows)) / (1 + n)) + 1 for t, n in df.items()}
        for k, (_, v) in enumerate(rows):
            w = {t: (1 + math.log(n)) * self.idf[t] for t, n in v.items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            for t, x in w.items():
                self.post.setdefault(t, []).append((k, x / norm))

    def dots(self, part: Counter) -> dict[int, float]:
        """Cosines of a vector to all texts that share a term with it."""
        w = {t: (1 + math.log(n)) * self.idf.get(t, math.log(1 + len(self.rows)) + 1) for t, n in part.items()}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
        dots: dict[int, float] = {}
        for t, x in w.items():
            for k, y in self.post.get(t, ()):
                dots[k] = dots.get(k, 0.0) + x * y / norm
        return dots


class Templates:
    def __init__(self, templates: dict[str, list[str]], full: dict[str, str] | None = None):
        self.headers = Vectors([(name, terms(_WORD.findall(t.lower()))) for name, ts in sorted(templates.items()) for t in ts])
        self.rows = self.headers.rows
        self.sizes = {sum(1 for t in v.elements() if " " not in t) for _, v in self.rows}
        self.known: dict[tuple[str, ...], tuple[float, str, int]] = {}
        full = FULL if full is None else full
        self.full = Vectors([(name, terms(_WORD.findall(t.lower()))) for name, t in sorted(full.items())])
        #: licences whose headers a full text holds itself
        self.own = {name: {k for k, (s, _) in self.passages(t.lower()).items() if s >= THRESHOLD} for name, t in full.items()}

    def best(self, words: list[str]) -> tuple[float, str, int]:
        """The most similar template, over all runs of words as long as its own, and that length; ties to the first name."""
        best = (0.0, "", 0)
        for size in self.sizes:
            for at in range(max(1, len(words) - size + 1)):
                dots = self.headers.dots(terms(words[at : at + size]))
                for k, s in dots.items():
                    if s > best[0] + 1e-12 or abs(s - best[0]) <= 1e-12 and best[1] and self.rows[k][0] < best[1]:
                        best = (s, self.rows[k][0], size)
        return best

    def passages(self, text: str) -> dict[str, tuple[float, int]]:
        """Score and template length of the best passage of each licence that is the best of one; text in lower case."""
        found: dict[str, tuple[float, int]] = {}
        done = -1
        for m in _CUE.finditer(text):
            if m.start() < done:
                continue
            before = _WORD.findall(text[max(0, m.start() - 12 * REACH) : m.start()])[-REACH:]
            after = _WORD.findall(text[m.start() : m.start() + 20 * REACH])[:REACH]
            passage = (*before, *after)
            if passage not in self.known:
                if len(self.known) >= TABLE:
                    self.known.clear()
                self.known[passage] = self.best([*passage])
            score, name, size = self.known[passage]
            found[name] = max(found.get(name, (score, size)), (score, size))
            done = m.end() + 8
        return found

    def scan(self, text: str, path: str = "") -> tuple[float, str, str]:
        """(score, licences, how) of a text: 'file', 'header' or 'none'; several licences are joined by AND, in the order of names."""
        text = text.lower()
        if not any(h in text for h in _HINTS):
            return 0.0, "", "none"
        found, words = self.passages(text), _WORD.findall(text)
        top, name = max(((s, self.full.rows[k][0]) for k, s in self.full.dots(terms(words)).items()), default=(0.0, ""))
        score = max((s for s, _ in found.values()), default=0.0)
        names = {k for k, (s, _) in found.items() if s >= THRESHOLD}
        if top >= FULL_THRESHOLD:
            return top, " AND ".join(sorted(names - self.own[name] | {name})), "file"
        if not names:
            return score, "", "none"
        return score, " AND ".join(sorted(names)), "file" if _FILE_NAME.search(path) else "header"


def _run(templates: dict[str, list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates(templates)
        for b in batches:
            rows = [t.scan(x or "", p or "") for x, p in zip(b.column("text").to_pylist(), b.column("path").to_pylist(), strict=True)]
            score, name, how = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("path"), pa.array(score, pa.float64()), pa.array(name, pa.string()), pa.array(how, pa.string())], ["id", "path", "score", "license", "how"])

    return run


def license_scan(files: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Licence of each row of ``files`` (id, path, text; others are not read).

    Gives id, path, license, how ('file', 'header', 'inherited' or 'none'), score and, where it is
    inherited, the directory. A null or empty text says nothing; a null path has no ancestors;
    several licence files of one directory give the best score's licence, ties to the first
    name. Rows are independent: null and repeated ids stay, and an empty table stays empty.
    """
    ship(files.sparkSession)
    rows = files.select(F.col("id").cast("long"), F.col("path").cast("string"), F.col("text").cast("string"))
    own = rows.mapInArrow(_run(templates or TEMPLATES), "id long, path string, score double, license string, how string")
    own = cut(own, "scans")[0].withColumn("parts", F.split("path", "/")).withColumn("depth", F.size("parts") - 1)
    held = own.where("how = 'file' and path is not null").select(F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("dir"), F.struct((-F.col("score")).alias("s"), "license").alias("x"))
    held = held.groupBy("dir").agg(F.min("x").alias("x")).select("dir", F.col("x.license").alias("theirs"))
    # the directories of silent files are joined once each, not once for each file
    silent = own.where("how = 'none' and path is not null").select(F.slice("parts", F.lit(1), F.col("depth")).alias("d")).distinct()
    up = silent.select(F.array_join("d", "/").alias("home"), "d", F.explode(F.sequence(F.lit(0), F.size("d"))).alias("k")).withColumn("dir", F.array_join(F.slice("d", F.lit(1), F.col("k")), "/"))
    near = up.join(held, "dir").groupBy("home").agg(F.max(F.struct("k", "dir", "theirs")).alias("n")).select("home", "n.dir", "n.theirs")
    home = F.when(F.col("how") == "none", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/"))
    out = own.withColumn("home", home).join(near, "home", "left")
    return out.select("id", "path", F.coalesce("theirs", "license").alias("license"), F.when(F.col("theirs").isNotNull(), "inherited").otherwise(F.col("how")).alias("how"), "score", F.col("dir").alias("inherited_from"))
