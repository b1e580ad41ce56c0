"""The dimension of writing modes, declared as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Mode, register, position in the interleave order (none for modes outside the corpus), least overlap of audits.
MODES = [
    ("tashih", "standard", 1, 0.35),
    ("rasmi", "formal", 2, 0.12),
    ("daneshgahi", "academic", 3, 0.12),
    ("edari", "admin", 4, 0.12),
    ("khodmani", "casual", 5, 0.15),
    ("adabi", "literary", 6, 0.10),
    ("lati", "street", 7, 0.12),
    ("taaroofi", "taarof", 8, 0.10),
    ("pachelhkhor", "flattery", 9, 0.08),
    ("naslezed", "genz", 10, 0.12),
    ("shaeraneh", "poetic", 11, 0.08),
    ("hoghooghi", "legal", None, None),
    ("divani", "divani", None, None),
]
HARD_MODES = ["rasmi", "daneshgahi", "edari", "adabi", "pachelhkhor", "shaeraneh"]
DEFAULT_MODE = "tashih"
#: Our own markers of a register, one pattern a mode; pass others for another corpus.
MARKERS = {"tashih": ".", "rasmi": "لطفاً|درخواست|اعلام", "daneshgahi": "پژوهش|تحلیل|شواهد", "edari": "خواهشمند|اقدام|پیوست", "khodmani": "یه|دیگه|آخه", "adabi": "سایه|خاموش|دل", "lati": "رفیق|داداش", "taaroofi": "لطف|زحمت", "pachelhkhor": "استاد|نابغه", "naslezed": "خفن|وایب", "shaeraneh": "شب|باران|ماه"}


def modes(spark: SparkSession, instructions: dict[str, str] | None = None, markers: dict[str, str] | None = None) -> DataFrame:
    """mode, register, position, in_pipeline, overlap_threshold, instruction, marker_regex."""
    told, marked = instructions or {}, markers or MARKERS
    rows = [(m, r, p, p is not None, t, told.get(m, f"Rewrite the text in the register {r}."), marked.get(m, ".")) for m, r, p, t in MODES]
    return spark.createDataFrame(rows, "mode string, register string, position int, in_pipeline boolean, overlap_threshold double, instruction string, marker_regex string")


#: Rows of a table of markers, at most: a pattern for each profile and mode.
MOST_MARKERS = 2_000


def markers_from_table(rows: DataFrame) -> dict[str, dict[str, str]]:
    """Patterns by profile (gate, audit, long audit, or others) and mode from a table (profile, mode, pattern); more than MOST_MARKERS rows are refused."""
    found = rows.select("profile", "mode", "pattern").limit(MOST_MARKERS + 1).collect()
    if len(found) > MOST_MARKERS:
        raise ValueError(f"more than {MOST_MARKERS} markers")
    out: dict[str, dict[str, str]] = {}
    for r in found:
        if r["pattern"] != out.setdefault(r["profile"], {}).setdefault(r["mode"], r["pattern"]):
            raise ValueError(f"two patterns for {r['mode']} in {r['profile']}")
    return out
