"""One text for both dialects: the few functions that are named differently."""

from __future__ import annotations


def pair(text: str) -> tuple[str, str]:
    """(Spark SQL, DuckDB SQL) of a text with @-macros."""
    spark = {"@words(": "split(", "@ws": r"'\\s+'", "@size(": "size(", "@explode(": "explode(", "@sha(": "sha2(", "@bits": ", 256)", "@list(": "collect_list("}
    duck = {"@words(": "regexp_split_to_array(", "@ws": r"'\s+'", "@size(": "len(", "@explode(": "unnest(", "@sha(": "sha256(", "@bits": ")", "@list(": "list("}
    out = []
    for names in (spark, duck):
        t = text
        for k, v in names.items():
            t = t.replace(k, v)
        out.append(t)
    return out[0], out[1]
