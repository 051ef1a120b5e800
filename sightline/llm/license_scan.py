"""License scan by sentence rules, with SQL functions only.

A text is cut into sentences twice: at sentence ends and line ends, and at
sentence ends and paragraph ends (for license texts wrapped over lines). A paragraph
ends at a line without a letter or digit, so comment marks neither join nor part
sentences; an SPDX tag is a sentence of its own. Each sentence is
normalised (ASCII lower case; other characters than a-z and 0-9 become one
space; where a license names its holder, one name stands for all) and looked up among
the known license sentences. The reading that finds
more of them gives the document's identifier sequence, in text order. Ordered
rules, each a sequence of identifiers, are then matched against it: the
identifiers must occur in the rule's order, with any others between them. Rules that
tell more come first and use up the identifiers they match, each occurrence of them,
so a rule contained in another (the two-clause license in the three-clause one) matches
only where there is a text of its own. The first rule that matches names the
license; all that match are listed.

Defined cases: a null or empty text has no sentence and no license; repeated
sentences repeat in the sequence; repeated rows give repeated results; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Normalised license sentences and their identifiers.
SENTENCES = {
    1: "licensed under the apache license version 2 0",
    2: "licensed under the apache license version 2 0 the license",
    3: "you may not use this file except in compliance with the license",
    4: "you may obtain a copy of the license at http www apache org licenses license 2 0",
    5: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    6: "see the license for the specific language governing permissions and limitations under the license",
    10: "released under the mit license",
    11: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    12: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    13: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    14: "licensed under the mit license",
    15: "this project is licensed under the mit license",
    20: "this work is licensed under the gnu general public license version 3",
    21: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    22: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    23: "either version 3 of the license or at your option any later version",
    24: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    25: "either version 2 of the license or at your option any later version",
    26: "this program is distributed in the hope that it will be useful but without any warranty",
    27: "without even the implied warranty of merchantability or fitness for a particular purpose",
    28: "this work is licensed under the gnu general public license version 2",
    29: "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    30: "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    40: "licensed under cc by nc 4 0",
    41: "licensed under cc by 4 0",
    42: "licensed under cc by sa 4 0",
    43: "this work is licensed under a creative commons attribution 4 0 international license",
    44: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    45: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    50: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    51: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    52: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    53: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    60: "this source code form is subject to the terms of the mozilla public license v 2 0",
    61: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    62: "this is free and unencumbered software released into the public domain",
    31: "either version 2 1 of the license or at your option any later version",
    32: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    33: "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    34: "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    35: "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    36: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    37: "licensed under the gnu general public license v3 0",
    38: "licensed under the gnu general public license v2 0",
    46: "licensed under cc by nc sa 4 0",
    47: "licensed under cc by nd 4 0",
    48: "licensed under cc by nc nd 4 0",
    49: "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    54: "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    55: "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    56: "neither the name of the nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    57: "this project is licensed under the bsd 3 clause license",
    58: "this project is licensed under the bsd 2 clause license",
    59: "this project is licensed under the apache license 2 0",
    63: "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    64: "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    65: "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    66: "distributed under the boost software license version 1 0",
    67: "this software is provided as is without any express or implied warranty",
    68: "in no event will the authors be held liable for any damages arising from the use of this software",
    69: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    70: "this font software is licensed under the sil open font license version 1 1",
    71: "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    72: "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    73: "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3 or any later version published by the free software foundation",
    74: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    7: "you may obtain a copy of the license at",
    8: "http www apache org licenses license 2 0",
    9: "apache license version 2 0 january 2004 http www apache org licenses",
    16: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    17: "the name of the copyright holder may not be used to endorse or promote products derived from this software without specific prior written permission",
    18: "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    19: "this source code form is subject to the terms of the mozilla public license v",
    80: "gnu general public license version 3 29 june 2007",
    81: "gnu general public license version 2 june 1991",
    82: "gnu lesser general public license version 3 29 june 2007",
    83: "gnu lesser general public license version 2 1 february 1999",
    84: "gnu affero general public license version 3 19 november 2007",
    85: "mozilla public license version 2 0",
    86: "eclipse public license v 2 0",
    87: "boost software license version 1 0 august 17th 2003",
    88: "cc0 1 0 universal",
    89: "sil open font license version 1 1 26 february 2007",
    90: "attribution 4 0 international",
    91: "attribution sharealike 4 0 international",
    92: "attribution noncommercial 4 0 international",
    93: "attribution noderivatives 4 0 international",
    94: "attribution noncommercial sharealike 4 0 international",
    95: "attribution noncommercial noderivatives 4 0 international",
}

# Ordered license rules; the more telling ones come first.
RULES = [
    ("AGPL-3.0", (30, 23)), ("AGPL-3.0", (32,)), ("AGPL-3.0", (33,)),
    ("LGPL-3.0", (29, 23)), ("LGPL-3.0", (34,)), ("LGPL-2.1", (29, 31)), ("LGPL-2.1", (35,)), ("LGPL-2.1", (29,)),
    ("GPL-3.0", (24, 23)), ("GPL-3.0", (22,)), ("GPL-3.0", (21,)), ("GPL-3.0", (20,)), ("GPL-3.0", (37,)),
    ("GPL-2.0", (24, 25)), ("GPL-2.0", (36,)), ("GPL-2.0", (28,)), ("GPL-2.0", (38,)),
    ("BSD-3-Clause", (50, 51, 52, 53)), ("BSD-3-Clause", (50, 51, 52, 56)), ("BSD-3-Clause", (57,)), ("BSD-3-Clause", (50, 51, 52, 17)), ("BSD-2-Clause", (50, 51, 52)), ("BSD-2-Clause", (58,)),
    ("MIT", (11, 12, 13)), ("MIT", (11, 12)), ("MIT", (12, 13)), ("MIT-0", (16,)), ("MIT", (10,)), ("MIT", (14,)), ("MIT", (15,)),
    ("Apache-2.0", (2, 3, 5, 6)), ("Apache-2.0", (2, 3)), ("Apache-2.0", (2,)), ("Apache-2.0", (1,)), ("Apache-2.0", (59,)), ("Apache-2.0", (9,)),
    ("CC-BY-NC-SA-4.0", (46,)), ("CC-BY-NC-SA-4.0", (49,)), ("CC-BY-NC-ND-4.0", (48,)), ("CC-BY-ND-4.0", (47,)), ("CC-BY-ND-4.0", (54,)),
    ("CC-BY-NC-4.0", (40,)), ("CC-BY-NC-4.0", (45,)), ("CC-BY-SA-4.0", (42,)), ("CC-BY-SA-4.0", (44,)),
    ("CC-BY-4.0", (41,)), ("CC-BY-4.0", (43,)), ("CC0-1.0", (55,)),
    ("MPL-2.0", (60, 63)), ("MPL-2.0", (60, 64)), ("MPL-2.0", (60,)), ("MPL-2.0", (19,)), ("ISC", (61,)), ("0BSD", (74,)), ("Unlicense", (62,)),
    ("BSL-1.0", (65,)), ("BSL-1.0", (66,)), ("Zlib", (67, 68, 69)), ("Zlib", (69,)), ("OFL-1.1", (70,)), ("EPL-2.0", (71,)), ("PostgreSQL", (72,)), ("GFDL-1.3", (73,)),
    ("GPL-3.0", (80,)), ("GPL-2.0", (81,)), ("LGPL-3.0", (82,)), ("LGPL-2.1", (83,)), ("AGPL-3.0", (84,)), ("MPL-2.0", (85,)), ("EPL-2.0", (86,)), ("BSL-1.0", (87,)), ("CC0-1.0", (88,)), ("OFL-1.1", (89,)),
    ("CC-BY-4.0", (90,)), ("CC-BY-SA-4.0", (91,)), ("CC-BY-NC-4.0", (92,)), ("CC-BY-ND-4.0", (93,)), ("CC-BY-NC-SA-4.0", (94,)), ("CC-BY-NC-ND-4.0", (95,)), ("ISC", (18,)),
]

# SPDX tags: one sentence for each name above, and for those of the GNU licenses with what may follow them.
for _k, _name in enumerate(dict.fromkeys(name for name, _ in list(RULES))):
    for _j, _end in enumerate(["", "-only", "-or-later"] if "GPL" in _name else [""]):
        SENTENCES[200 + 3 * _k + _j] = "spdx license identifier " + " ".join(re.findall("[a-z0-9]+", (_name + _end).lower()))
        RULES.append((_name, (200 + 3 * _k + _j,)))

#: Sentences that name a holder: how they begin, a pattern of the name, and what stands for it.
SLOTS = [
    ("neither the name", "^neither the names? of .+ nor the names of (its|the|their|any|other) contributors", "neither the name of the copyright holder nor the names of its contributors"),
    ("the name", "^the names? of .+ may not be used", "the name of the copyright holder may not be used"),
]
#: The end of a paragraph: a line without a letter or digit.
PARAGRAPH = "\\n[^A-Za-z0-9\\n]*\\n"
SPDX = "SPDX-License-Identifier:[\\x20\\x09]*\\(?([A-Za-z0-9.-]+)"


def rule_pattern(ids: tuple[int, ...]) -> str:
    return "(.*?)".join(f"<{i}>" for i in ids)


def _named(start: str, slot: str, name: str):
    """One name for all holders, in sentences that begin so."""
    return lambda s: F.when(F.startswith(s, F.lit(start)), F.regexp_replace(s, slot, name)).otherwise(s)


def _identifiers(cut: Column) -> Column:
    """The known sentences' identifiers, in order. One transform a step: what a lambda uses twice is computed twice."""
    plain = F.transform(F.split(F.translate(cut, "\x1e", "\n"), "\n"), lambda s: F.trim(F.regexp_replace(F.translate(s, UPPER, LOWER), "[^a-z0-9]+", " ")))
    starts = [start for start, _, _ in SLOTS]
    known = F.filter(plain, lambda s: s.isin(*SENTENCES.values()) | F.startswith(s, F.lit(starts[0])) | F.startswith(s, F.lit(starts[1])))
    for slot in SLOTS:
        known = F.transform(known, _named(*slot))
    known = F.filter(known, lambda s: s.isin(*SENTENCES.values()))
    names = F.create_map(*[F.lit(x) for k, v in SENTENCES.items() for x in (v, f"<{k}>")])
    return F.transform(known, lambda s: F.element_at(names, s))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_sentences, sentence_ids, license, licenses."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPDX, "\x1eSPDX-License-Identifier $1\x1e")
    told = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    paragraphs = F.regexp_replace("_text", PARAGRAPH, "\x1e")
    read = told.select(
        "_id",
        _identifiers(F.regexp_replace("_text", "([.!?;:])[\\x20\\x09-\\x0D]+", "$1\n")).alias("by_line"),
        _identifiers(F.regexp_replace(F.regexp_replace(paragraphs, "[\\x09-\\x0D]", " "), "([.!?;:])\\x20+", "$1\n")).alias("by_end"),
    )
    read = read.select("_id", F.when(F.size("by_end") > F.size("by_line"), F.col("by_end")).otherwise(F.col("by_line")).alias("ids"))
    read = read.select("_id", F.size("ids").cast("long").alias("n_sentences"), F.concat_ws("", "ids").alias("sentence_ids"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(rule_pattern(ids)).alias("ids"), F.lit("".join(f"${k}" for k in range(1, len(ids)))).alias("others")) for name, ids in RULES])
    none = F.array().cast("array<string>")
    apply = lambda acc, rule: F.when(
        F.rlike(acc.left, rule.ids), F.struct(F.regexp_replace(acc.left, rule.ids, rule.others).alias("left"), F.array_append(acc.names, rule["name"]).alias("names"))).otherwise(acc)
    matched = F.aggregate(rules, F.struct(F.col("sentence_ids").alias("left"), none.alias("names")), apply, lambda acc: F.array_distinct(acc.names))
    return (
        read.withColumn("found", F.when(F.col("n_sentences") > 0, matched).otherwise(none))
        .select(F.col("_id").alias(id_col), "n_sentences", "sentence_ids",
                F.get("found", F.lit(0)).alias("license"), F.concat_ws(",", "found").alias("licenses"))
    )


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def sql() -> str:
    known = ", ".join(f"('{v}', {k})" for k, v in SENTENCES.items())
    steps = ",\n    ".join(
        f"r{n + 1} AS (SELECT rid, regexp_replace(rest, '{rule_pattern(ids)}', '{''.join(f'{chr(92)}{k}' for k in range(1, len(ids)))}', 'g') AS rest, "
        f"CASE WHEN regexp_matches(rest, '{rule_pattern(ids)}') THEN list_append(names, '{name}') ELSE names END AS names FROM r{n})" for n, (name, ids) in enumerate(RULES))
    plain = f"trim(regexp_replace(translate(part, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' ')"
    for _, slot, name in SLOTS:
        plain = f"regexp_replace({plain}, '{slot}', '{name}')"
    side = lambda name, cut: f"""{name} AS (
        SELECT doc_id, rid, list('<' || k || '>' ORDER BY place) AS ids FROM (
            SELECT doc_id, rid, unnest(parts) AS part, generate_subscripts(parts, 1) AS place
            FROM (SELECT doc_id, rid, string_split_regex({cut}, '[\\n\\x1E]') AS parts FROM d)) p
        JOIN known ON s = {plain}
        GROUP BY doc_id, rid)"""  # noqa: E731
    by_line = r"regexp_replace(t, '([.!?;:])[\x20\x09-\x0D]+', '\1' || chr(10), 'g')"
    by_end = rf"regexp_replace(regexp_replace(regexp_replace(t, '{PARAGRAPH}', chr(30), 'g'), '[\x09-\x0D]', ' ', 'g'), '([.!?;:])\x20+', '\1' || chr(10), 'g')"
    tagged = rf"regexp_replace(coalesce(text, ''), '{SPDX}', chr(30) || 'SPDX-License-Identifier \1' || chr(30), 'g')"
    return f"""
    WITH d AS (SELECT doc_id, {tagged} AS t, row_number() OVER () AS rid FROM documents),
    known(s, k) AS (VALUES {known}),
    {side('by_line', by_line)}, {side('by_end', by_end)},
    read AS (SELECT d.doc_id, d.rid, CASE WHEN coalesce(len(e.ids), 0) > coalesce(len(l.ids), 0) THEN e.ids ELSE coalesce(l.ids, []) END AS ids
             FROM d LEFT JOIN by_line l USING (rid) LEFT JOIN by_end e ON e.rid = d.rid),
    r0 AS (SELECT rid, array_to_string(ids, '') AS rest, []::VARCHAR[] AS names FROM read WHERE len(ids) > 0),
    {steps},
    named AS (SELECT rid, list_filter(names, lambda x, i: list_position(names, x) = i) AS names FROM r{len(RULES)})
    SELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, '') AS sentence_ids,
           names[1] AS license, coalesce(array_to_string(names, ','), '') AS licenses
    FROM read LEFT JOIN named USING (rid)
    """
