"""License scans by sentence rules.

Every text is cut in sentences, across line ends, as licence texts are wrapped; normalised sentences
that are known get identifiers, and of an unknown sentence each line that is known by itself. The
sequence of a document's identifiers is then matched against ordered rules, each of which consumes
what it matches. All of it is built-in expressions over one scan, without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of common licences and of references to them, with identifiers.
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2 0": "ApacheRef",
    "licensed under the apache license version 2 0 the license": "ApacheRef",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at": "ApacheObtain",
    "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsIs",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "released under the mit license": "MITRef",
    "licensed under the mit license": "MITRef",
    "this software is released under the mit license": "MITRef",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITPermission",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MITAsIs",
    "this work is licensed under the gnu general public license version 3": "GPL3Ref",
    "licensed under the gnu general public license version 3": "GPL3Ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3Later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2Later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPLNoWarranty",
    "see the gnu general public license for more details": "GPLSee",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDRedistribution",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDEndorse",
    "licensed under cc by nc 4 0": "CCBYNC4Ref",
    "licensed under cc by 4 0": "CCBY4Ref",
    "licensed under cc by sa 4 0": "CCBYSA4Ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "CCBY4Ref",
    "all rights reserved": "Reserved",
    "all rights reserved copyright": "Reserved",
    "copyright all rights reserved": "Reserved",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "ApacheHeader",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsIs",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MITLiability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCPermission",
    "this source code form is subject to the terms of the mozilla public license v": "MPL2Form",
    "this is free and unencumbered software released into the public domain": "UnlicenseFree",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "CC0Waiver",
}

# The GNU notices name the program's licence by title and version; titles with the names of their rules.
GNU = (("general public license", "GPL"), ("lesser general public license", "LGPL"), ("affero general public license", "AGPL"))
GNU_VERSIONS = {"GPL": ("2", "3"), "LGPL": ("2 1", "3"), "AGPL": ("3",)}
# Identifiers of SPDX lines.
SPDX = (
    "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0-only",
    "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense",
)

for _title, _short in GNU:
    for _version in GNU_VERSIONS[_short]:
        _terms = f"you can redistribute it and or modify it under the terms of the gnu {_title} as published by the free software foundation either version {_version} of the license or at your option any later version"
        for _start in ("", "this program is free software ", "this library is free software "):
            SENTENCES.setdefault(_start + _terms, f"{_short}{_version.replace(' ', '')}Later")
    SENTENCES.setdefault(f"see the gnu {_title} for more details", "GPLSee")
SENTENCES.setdefault("this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "GPLNoWarranty")
for _name in SPDX:
    SENTENCES[f"spdx license identifier {re.sub('[^a-z0-9]+', ' ', _name.lower())}"] = f"SPDX{_name}"

# Ordered rules; an earlier rule consumes its identifiers before later ones look.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("MITPermission", "MITNotice", "MITAsIs", "MITLiability")),
    ("MIT", ("MITPermission", "MITNotice", "MITAsIs")),
    ("BSD-3-Clause", ("Reserved", "BSDRedistribution", "BSDSource", "BSDBinary", "BSDEndorse")),
    ("BSD-2-Clause", ("Reserved", "BSDRedistribution", "BSDSource", "BSDBinary")),
    ("BSD-3-Clause", ("BSDRedistribution", "BSDSource", "BSDBinary", "BSDEndorse")),
    ("BSD-2-Clause", ("BSDRedistribution", "BSDSource", "BSDBinary")),
    ("Apache-2.0", ("ApacheRef", "ApacheComply", "ApacheObtain", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("ApacheHeader", "ApacheObtain", "ApacheAsIs", "ApacheSee")),
    ("GPL-3.0-or-later", ("GPL3Later", "GPLNoWarranty", "GPLSee")),
    ("GPL-2.0-or-later", ("GPL2Later", "GPLNoWarranty", "GPLSee")),
    ("GPL-3.0-or-later", ("GPL3Later",)),
    ("GPL-2.0-or-later", ("GPL2Later",)),
    ("LGPL-2.1-or-later", ("LGPL21Later", "GPLNoWarranty", "GPLSee")),
    ("LGPL-3.0-or-later", ("LGPL3Later", "GPLNoWarranty", "GPLSee")),
    ("AGPL-3.0-or-later", ("AGPL3Later", "GPLNoWarranty", "GPLSee")),
    ("LGPL-2.1-or-later", ("LGPL21Later",)),
    ("LGPL-3.0-or-later", ("LGPL3Later",)),
    ("AGPL-3.0-or-later", ("AGPL3Later",)),
    ("MIT", ("MITPermission", "MITNotice")),
    ("ISC", ("ISCPermission",)),
    ("MPL-2.0", ("MPL2Form",)),
    ("Unlicense", ("UnlicenseFree",)),
    ("CC0-1.0", ("CC0Waiver",)),
    ("Apache-2.0", ("ApacheHeader",)),
    ("Apache-2.0", ("ApacheRef",)),
    ("MIT", ("MITRef",)),
    ("GPL-3.0-only", ("GPL3Ref",)),
    ("CC-BY-NC-4.0", ("CCBYNC4Ref",)),
    ("CC-BY-SA-4.0", ("CCBYSA4Ref",)),
    ("CC-BY-4.0", ("CCBY4Ref",)),
    *((name, (f"SPDX{name}",)) for name in SPDX),
    ("Proprietary", ("Reserved",)),
)

#: Ends of sentences: their marks, and lines that are empty but for comment marks. Every known sentence holds one
#: of the words. A copyright line is a sentence of its own, and the colon of an SPDX line ends none.
SPLIT = r"[.!?:]+[ \t\r\n]+|\n[ \t\r*#/;-]*\n"
LINE = r"[\r\n]+"
HINT = "licen|copyright|warrant|permi|redistribut|reserved|liab|public domain"
COPYRIGHT_LINE = r"(^|\n)([^\n]*copyright \(c\)[^\n]*)"
SPDX_MARK = "spdx-license-identifier:"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def identifiers(text: str = "text", sentences: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    look_up = lambda s: F.try_element_at(known, F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    low = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    low = F.replace(low, F.lit(SPDX_MARK), F.lit(SPDX_MARK[:-1]))
    hinted = F.filter(F.split(F.regexp_replace(low, COPYRIGHT_LINE, "\n\n$2\n\n"), SPLIT), lambda s: s.rlike(HINT))
    lines = lambda s: F.filter(F.transform(F.split(s, LINE), look_up), lambda x: x.isNotNull())
    return F.flatten(F.transform(hinted, lambda s: F.when(look_up(s).isNotNull(), F.array(look_up(s))).otherwise(lines(s))))


def license_scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses, n_unmatched) of every document.

    ``sentence_ids`` joins the identifiers in order, ``licenses`` the names of the rules that matched
    (each once, in rule order) and ``n_unmatched`` counts identifiers that no rule consumed. Defined
    results: null, empty and licence-free texts have 0, "", "" and 0; repeated rows are scanned each
    for itself; an empty table gives no rows.
    """
    out = docs.select("doc_id", identifiers(sentences=sentences).alias("ids"))
    ordered = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("," + ",".join(ids) + ",").alias("ids")) for name, ids in rules])
    rest = F.concat(F.lit(","), F.array_join("ids", ","), F.lit(","))

    def apply_rule(state: Column, rule: Column) -> Column:
        new = F.contains(state["rest"], rule["ids"]) & ~F.array_contains(state["names"], rule["name"])
        names = F.when(new, F.array_append(state["names"], rule["name"])).otherwise(state["names"])
        # twice: neighbouring matches share a comma
        once = F.replace(state["rest"], rule["ids"], F.lit(",#,"))
        return F.struct(F.replace(once, rule["ids"], F.lit(",#,")).alias("rest"), names.alias("names"))

    start = F.struct(rest.alias("rest"), F.array().cast("array<string>").alias("names"))
    # docs without a licence sentence, nearly all, end here
    out = out.withColumn("end", F.when(F.size("ids") > 0, F.aggregate(ordered, start, apply_rule)))
    left = F.size(F.filter(F.split("end.rest", ","), lambda x: (x != "") & (x != "#")))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"),
        F.coalesce(F.array_join("end.names", ","), F.lit("")).alias("licenses"), F.when(F.size("ids") > 0, left).otherwise(0).cast("long").alias("n_unmatched"),
    )


def license_sql() -> str:
    """The same in DuckDB."""
    keys = ", ".join(f"'{s}'" for s in SENTENCES)
    values = ", ".join(f"'{i}'" for i in SENTENCES.values())
    raw = lambda pattern: pattern.encode().decode("unicode_escape") if "(" not in pattern else pattern
    look_up = lambda s: f"list_extract([{values}], list_position([{keys}], trim(regexp_replace({s}, '[^a-z0-9]+', ' ', 'g'))))"
    low = f"replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPDX_MARK}', '{SPDX_MARK[:-1]}')"
    cut = f"string_split_regex(regexp_replace({low}, '{COPYRIGHT_LINE}', chr(10) || chr(10) || '\\2' || chr(10) || chr(10), 'g'), '{raw(SPLIT)}')"
    steps = [
        f"""with h as (select doc_id, list_filter({cut}, lambda s: regexp_matches(s, '{HINT}')) hinted from documents),
    s as (select doc_id, flatten(list_transform(hinted, lambda s: case when {look_up('s')} is not null then [{look_up('s')}]
        else list_filter(list_transform(string_split_regex(s, '{raw(LINE)}'), lambda l: {look_up('l')}), lambda x: x is not null) end)) ids from h),
    r0 as (select doc_id, ids, ',' || coalesce(list_aggregate(list_transform(ids, lambda x: x || ','), 'string_agg', ''), '') rest, '' names from s)"""
    ]
    for i, (name, ids) in enumerate(RULES):
        p = "," + ",".join(ids) + ","
        steps.append(
            f"r{i + 1} as (select doc_id, ids, replace(replace(rest, '{p}', ',#,'), '{p}', ',#,') rest, names || case when contains(rest, '{p}') and not contains(',' || names, ',{name},') then '{name},' else '' end names from r{i})"
        )
    n = len(RULES)
    return (
        ",\n".join(steps)
        + f"\nselect doc_id, len(ids)::bigint n_sentences, coalesce(list_aggregate(ids, 'string_agg', ','), '') sentence_ids, regexp_replace(names, ',$', '') licenses, len(list_filter(string_split(rest, ','), lambda x: x <> '' and x <> '#'))::bigint n_unmatched from r{n}"
    )
