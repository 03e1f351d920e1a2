"""Licence recognition by sentences, in DataFrame expressions.

A text is cut into sentences, each is normalised and looked up among known licence sentences: whole, with its lines joined,
and where that is no known one, line by line. What remains is the sequence of identifiers in text order, against which the rules are matched one after the other: a rule is a run of identifiers, and
a matched run is used up, so a rule for a whole licence must stand before those for its parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, without

#: Known sentences of public licences in normalised form, by identifier.
SENTENCES = {
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-warranty": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "mit-liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "mit-line": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "this software is released under the mit license", "spdx license identifier mit"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-line": ["released under the isc license", "licensed under the isc license", "spdx license identifier isc"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-names": ["neither the name of x nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-warranty": ["this software is provided by x as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "bsd2-line": ["licensed under the bsd 2 clause license", "released under the bsd 2 clause license", "spdx license identifier bsd 2 clause"],
    "bsd3-line": ["licensed under the bsd 3 clause license", "released under the bsd 3 clause license", "spdx license identifier bsd 3 clause"],
    "bsd-line": ["licensed under the bsd license", "released under the bsd license"],
    "apache2-header": ["licensed under the apache license version 2.0 the license"],
    "apache2-use": ["you may not use this file except in compliance with the license"],
    "apache2-copy": ["you may obtain a copy of the license at http www.apache.org licenses license 2.0"],
    "apache2-basis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache2-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "apache2-line": ["licensed under the apache license version 2.0", "released under the apache license 2.0", "released under the apache license version 2.0", "spdx license identifier apache 2.0"],
    "gpl2-terms": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl3-terms": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl-publish": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "gpl2-option": ["either version 2 of the license or at your option any later version"],
    "gpl3-option": ["either version 3 of the license or at your option any later version"],
    "gpl-warranty": ["this program is distributed in the hope that it will be useful but without any warranty"],
    "gpl-implied": ["without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl-see": ["see the gnu general public license for more details"],
    "gpl-copy": ["you should have received a copy of the gnu general public license along with this program"],
    "gpl2-line": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "spdx license identifier gpl 2.0 only", "spdx license identifier gpl 2.0 or later"],
    "gpl3-line": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "spdx license identifier gpl 3.0 only", "spdx license identifier gpl 3.0 or later"],
    "lgpl3-line": ["licensed under the gnu lesser general public license version 3", "spdx license identifier lgpl 3.0 only", "spdx license identifier lgpl 3.0 or later"],
    "agpl3-line": ["licensed under the gnu affero general public license version 3", "spdx license identifier agpl 3.0 only", "spdx license identifier agpl 3.0 or later"],
    "mpl2-terms": ["this source code form is subject to the terms of the mozilla public license v 2.0"],
    "mpl2-copy": ["if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0"],
    "cc-by-line": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa-line": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc-by-nc-line": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc-by-nd-line": ["licensed under cc by nd 4.0", "this work is licensed under a creative commons attribution noderivatives 4.0 international license"],
    "cc0-line": ["licensed under cc0 1.0", "spdx license identifier cc0 1.0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "arr": ["all rights reserved"],
}
#: Ordered rules, (licence, identifiers that follow one another).
RULES = [
    ("MIT", "mit-grant mit-notice mit-warranty mit-liability"), ("MIT", "mit-grant mit-notice mit-warranty"), ("MIT", "mit-grant mit-notice"),
    ("ISC", "isc-grant mit-warranty"), ("ISC", "isc-grant"),
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-names bsd-warranty"), ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-names"),
    ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary bsd-warranty"), ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary"),
    ("Apache-2.0", "apache2-header apache2-use apache2-copy apache2-basis apache2-see"), ("Apache-2.0", "apache2-header apache2-use"), ("Apache-2.0", "apache2-header"),
    ("GPL-2.0-or-later", "gpl2-terms gpl-hope gpl-see gpl-copy"), ("GPL-2.0-or-later", "gpl2-terms"),
    ("GPL-3.0-or-later", "gpl3-terms gpl-hope gpl-see gpl-copy"), ("GPL-3.0-or-later", "gpl3-terms"),
    ("MPL-2.0", "mpl2-terms mpl2-copy"), ("MPL-2.0", "mpl2-terms"),
    ("MIT", "mit-line"), ("ISC", "isc-line"), ("BSD-2-Clause", "bsd2-line"), ("BSD-3-Clause", "bsd3-line"), ("BSD", "bsd-line"), ("Apache-2.0", "apache2-line"),
    ("GPL-2.0", "gpl2-line"), ("GPL-3.0", "gpl3-line"), ("LGPL-3.0", "lgpl3-line"), ("AGPL-3.0", "agpl3-line"), ("CC-BY-4.0", "cc-by-line"),
    ("CC-BY-SA-4.0", "cc-by-sa-line"), ("CC-BY-NC-4.0", "cc-by-nc-line"), ("CC-BY-ND-4.0", "cc-by-nd-line"), ("CC0-1.0", "cc0-line"), ("Unlicense", "unlicense"),
]
#: Sentences that some texts write in two, parted by a semicolon: (identifier, identifiers of its parts).
PARTS = [("gpl2-terms", "gpl-publish gpl2-option"), ("gpl3-terms", "gpl-publish gpl3-option"), ("gpl-hope", "gpl-warranty gpl-implied")]
#: Every known sentence has one of these; other sentences are not looked up.
HINTS = ("licen", "permission", "warrant", "redistribut", "liab", "public domain", "mpl", "rights reserved")
_BLANK = r"[\x20\x09-\x0D]+"
#: A dot after these does not end a sentence.
SHORT = r"\b([Ii]nc|INC|[Ll]td|LTD|[Cc]orp|CORP|[Vv])\." + _BLANK
#: Parts of a sentence that name a holder are made alike: the sentence's beginning, what follows the name.
HOLDERS = (("neither the name of ", " nor the names"), ("this software is provided by ", " as is"))
_END = "\x01"
_SIGNS = r"[^A-Za-z0-9\n]*"
#: Replacements that turn the end of a sentence into one mark, in this order: for Java and for DuckDB, whose groups are \1.
ENDS = (
    (SHORT, "{1} "),
    (r"\r\n?", "\n"),
    (rf"\n{_SIGNS}\n{_SIGNS}(https?://)", " {1}"),                                   # an address set apart belongs to its sentence
    (rf"(^|\n)({_SIGNS}([Cc]opyright|COPYRIGHT|SPDX-)[^\n]*)", "{1}" + _END + "{2}" + _END),    # lines that stand for themselves
    (rf"(:[\x20\x09]*|\n{_SIGNS})\n", _END),                                        # a list follows, or a line without a word
    (r"([^\x20\x09-\x0D;][.!?;])" + _BLANK, "{1}" + _END),
)
#: A label such as (a) or 2) before a sentence.
_LABEL = r"^[^A-Za-z0-9(]*[(]?([A-Za-z]|[0-9]{1,2})[)] "


def _normal(s: Column) -> Column:
    """Lower case, only ASCII letters, digits and inner dots kept, words parted by one blank."""
    s = F.regexp_replace(lower_ascii(F.regexp_replace(s, _LABEL, "")), "[^a-z0-9.]+", " ")
    s = F.regexp_replace(s, r"^[ .]+|[ .]+$", "")
    for start, then in HOLDERS:
        s = F.when(s.startswith(start), F.regexp_replace(s, f"^{start}.+?{then}", f"{start}x{then}")).otherwise(s)
    return s


def sentences(text: Column) -> Column:
    """Raw sentences, their line ends kept: cut after . ! ? ; between a sign and a blank, after a colon at a line's end, at lines without
    a letter or digit, and around copyright and SPDX lines. Common abbreviations do not end one."""
    for pattern, to in ENDS:
        text = F.regexp_replace(text, pattern, to.format(None, "$1", "$2"))
    return F.split(text, _END, -1)


def _any(s: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | s.contains(w)
    return out


def _joined(seq, replace, rules, parts):
    """The sequence with parts put together and each rule's run replaced by its licence; for columns and for SQL text."""
    of = lambda run: "".join(f"<{i}>" for i in run.split())
    for i, run in parts:
        seq = replace(seq, of(run), f"<{i}>")
    for name, run in rules:
        seq = replace(seq, of(run), f"[{name}]")
    return seq


def scan_licences(docs: DataFrame, text: str = "text", known=None, rules=RULES, parts=PARTS) -> DataFrame:
    """Adds `sentence_ids` (known sentences in text order), `licences` (of the rules that match, in alphabetical order, each
    once) and `unresolved` (identifiers no rule used).

    A null text has no sentence; an empty table gives an empty one. Rows are judged one by one, without a shuffle; repeated
    rows alike; columns of the output's names are replaced."""
    known = known or SENTENCES
    docs = without(docs, "sentence_ids", "licences", "unresolved", "_seq")
    table = F.create_map(*[F.lit(x) for i, ss in known.items() for s in ss for x in (s, i)])

    def look(pair: Column) -> Column:
        whole = F.try_element_at(table, pair["n"])
        lines = F.transform(F.split(pair["s"], "\n", -1), lambda line: F.try_element_at(table, _normal(line)))
        return F.when(whole.isNotNull() | ~pair["s"].contains("\n"), F.array(whole)).otherwise(lines)

    pairs = F.transform(sentences(F.col(text)), lambda s: F.struct(s.alias("s"), _normal(s).alias("n")))
    found = F.flatten(F.transform(F.filter(pairs, lambda p: _any(p["n"], HINTS)), look))
    # a hint of two words can stand apart by any blanks or signs, as in a normalised sentence
    plain = F.regexp_replace(lower_ascii(F.col(text)), "[^a-z0-9.]+", " ")
    ids = F.when(_any(plain, HINTS), F.array_compact(found))
    docs = docs.withColumn("sentence_ids", F.coalesce(ids, F.array().cast("array<string>")))
    docs = docs.withColumn("_seq", F.concat_ws("", F.transform("sentence_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">")))))
    docs = docs.withColumn("_seq", _joined(F.col("_seq"), lambda x, old, new: F.replace(x, F.lit(old), F.lit(new)), rules, parts))
    return (docs.withColumn("licences", F.array_sort(F.array_distinct(F.regexp_extract_all("_seq", F.lit(r"\[([^\]]+)\]"), F.lit(1)))))
            .withColumn("unresolved", F.regexp_extract_all("_seq", F.lit("<([^>]+)>"), F.lit(1))).drop("_seq"))


def licences_sql() -> str:
    """DuckDB: doc_id and the three results, comma-joined."""
    def normal(s):
        s = f"translate(regexp_replace({s}, '{_LABEL}', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        s = f"regexp_replace(regexp_replace({s}, '[^a-z0-9.]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')"
        for start, then in HOLDERS:
            s = f"regexp_replace({s}, '^{start}.+?{then}', '{start}x{then}')"
        return s

    cut = "text"
    for pattern, to in ENDS:
        cut = f"regexp_replace({cut}, '{pattern}', '{to.format(None, chr(92) + '1', chr(92) + '2')}', 'g')"
    values = ", ".join(f"('{s}', '{i}')" for i, ss in SENTENCES.items() for s in ss)
    seq = _joined("seq", lambda x, old, new: f"replace({x}, '{old}', '{new}')", RULES, PARTS)
    return rf"""
WITH k(n, id) AS (VALUES {values}),
 x AS (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, string_split({cut}, '{_END}') AS parts FROM documents)),
 w AS (SELECT doc_id, i, s, id FROM (SELECT *, {normal('s')} AS n FROM x) LEFT JOIN k USING (n)),
 l AS (SELECT doc_id, i, unnest(lines) AS s, generate_subscripts(lines, 1) AS j FROM (SELECT doc_id, i, string_split(s, chr(10)) AS lines FROM w WHERE id IS NULL)),
 n AS (SELECT doc_id, i, 0 AS j, id FROM w WHERE id IS NOT NULL
       UNION ALL SELECT doc_id, i, j, id FROM (SELECT *, {normal('s')} AS n FROM l) JOIN k USING (n)),
 q AS (SELECT doc_id, string_agg(id, ',' ORDER BY i, j) AS sentence_ids, string_agg('<' || id || '>', '' ORDER BY i, j) AS seq FROM n GROUP BY 1),
 r AS (SELECT doc_id, sentence_ids, {seq} AS seq FROM q)
SELECT d.doc_id, coalesce(sentence_ids, '') AS sentence_ids,
       coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(seq, '\[([^\]]+)\]', 1))), ','), '') AS licences,
       coalesce(array_to_string(regexp_extract_all(seq, '<([^>]+)>', 1), ','), '') AS unresolved
FROM documents d LEFT JOIN r USING (doc_id)"""
