"""Finding what a folder holds: lexicons by file name, raw vocabularies by layout, members of archives."""

from __future__ import annotations

import re
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession

from noteloom.sources.readers import hadoop_path, listed, term_list

# File prefixes of lexicons, terms where a category has no file, and where raw vocabularies lie.
PREFIXES = {"actions": "candidate_treatment_actions__", "reasons": "candidate_discontinuation_reasons__", "context": "candidate_treatment_context__", "entities": "ehr_entities__"}
FALLBACKS = {
    "actions": {"start": ("start",), "stop": ("stop",), "hold": ("hold",), "dose_change": ("dose reduced",)},
    "reasons": {"toxicity": ("toxicity",), "progression": ("progression",)},
    "context": {"regimen": ("regimen",)},
}
# name: (words in the first folder, words not in it, patterns of the rest of the path in order of preference)
LAYOUT = {
    "rxnorm": (("rxnorm", "prescribe"), (), ("rrf/RXNCONSO.RRF",)),
    "icd10cm": (("icd", "cm"), ("pcs",), ("Code Descriptions/icd10cm_codes_2026.txt", "icd10cm_codes*.txt", "*/icd10cm_codes*.txt")),
    "loinc": (("loinc",), (), ("LoincTable/Loinc.csv", "LoincTableCore/LoincTableCore.csv")),
    "icd10pcs": (("icd", "pcs"), (), ("icd10pcs_order*.txt", "*/icd10pcs_order*.txt")),
    "ncit": (("ncit",), (), ("Thesaurus.txt",)),
}
#: name: (words in the file's name, endings in order of preference, only at the top)
SHEETS = {"sdtm": (("sdtm", "terminology"), (".xls", ".xlsx", ".csv"), False), "ctcae": (("ctcae",), (".xlsx", ".csv"), True)}
# End of the fixed values.


def lexicons(spark: SparkSession, folder: str) -> dict[str, dict[str, tuple[str, ...]]]:
    """Terms by group and category of the folder's CSV and text files, named by a group's prefix and the category; built-in terms
    for categories that must be there and have no file. Lexicons are lists that people keep: they are read to the driver."""
    out: dict[str, dict[str, tuple[str, ...]]] = {g: {} for g in PREFIXES}
    files = listed(spark, folder)
    for path in [p for end in (".csv", ".txt") for p in sorted(files) if p.endswith(end)]:
        stem = path.rsplit("/", 1)[-1][:-4]
        group = next((g for g, p in PREFIXES.items() if stem.startswith(p)), None)
        if group:
            out[group][stem.removeprefix(PREFIXES[group])] = tuple(r["term"] for r in term_list(spark, path).orderBy("ord").collect())
    return {g: dict(FALLBACKS.get(g, {})) | found for g, found in out.items()}


def walk(spark: SparkSession, root: str) -> list[str]:
    """Paths of all files below a folder, relative to it, in order."""
    path, fs = hadoop_path(spark, root)
    base, files, it = fs.makeQualified(path).toString().rstrip("/") + "/", [], fs.listFiles(path, True)
    while it.hasNext():
        files.append(it.next().getPath().toString().removeprefix(base))
    return sorted(files)


def raw_vocabularies(spark: SparkSession, root: str) -> dict[str, str]:
    """Path of each raw vocabulary that lies below a folder in the layout it is published in."""
    files, found = walk(spark, root), {}
    for name, (words, without, patterns) in LAYOUT.items():
        own = [p.split("/", 1) for p in files if "/" in p]
        own = [(d, rest) for d, rest in own if all(w in d.lower() for w in words) and not any(w in d.lower() for w in without)]
        hit = next((f"{d}/{rest}" for pattern in patterns for d, rest in own if fnmatchcase(rest, pattern)), None)
        if hit:
            found[name] = f"{root.rstrip('/')}/{hit}"
    for name, (words, endings, top) in SHEETS.items():
        own = [p for p in files if all(w in p.rsplit("/", 1)[-1].lower() for w in words) and not (top and "/" in p)]
        hit = next((p for e in endings for p in own if p.endswith(e)), None)
        if hit:
            found[name] = f"{root.rstrip('/')}/{hit}"
    return found


def zip_members(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, member, content) of the members of zip archives whose name holds the pattern, in any case; one archive is one task's."""

    def opened(batches):
        import io
        import zipfile

        import pandas as pd

        wanted = re.compile(pattern, re.IGNORECASE)
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in filter(wanted.search, z.namelist()):
                        yield pd.DataFrame({"path": [where], "member": [name], "content": [z.read(name)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(opened, "path string, member string, content binary")
