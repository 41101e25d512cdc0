"""License scans by sentence rules (native).

A text is cut after . ! ? ; : before a space or line end (but for the colon of
a licence tag) and at lines without letters and digits. Any other line end may part two sentences or wrap one: a
known sentence, lower-cased and with everything but letters and digits (comment
marks too) made single spaces, can go over any number of lines, from the start
of one to the end of one. Of two known ones that begin in one place the longer is
taken; lines between that are no part of one are one unknown sentence, ``-``. The
identifiers of a text, in order, make a line on which the ordered rules are
matched: a rule's identifiers follow one another with at most ``GAP`` unknown
sentences between two. Matches are the leftmost ones, and of the rules that
begin at one place the longest wins.

Only a text with one of the cue words can hold a known sentence; the others are
not cut up. Null and empty texts, and texts without licence sentences, give a
row without findings. Repeated rows each give a row.

``ORACLE_SQL`` cuts at every line end. It says the same for texts whose notices
have each sentence on one line and no unknown sentence of more lines between.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

GAP = 2
#: Identifier and normalised wording of the known sentences of licence notices.
NOTICES = (
    ("agpl3-later", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl3-only", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation version 3"),
    ("agpl3-only-the", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation version 3 of the license"),
    ("apache-notice", "licensed under the apache license version 2 0"),
    ("apache-notice-the", "licensed under the apache license version 2 0 the license"),
    ("apache-compliance", "you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at"),
    ("apache-as-is", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("boost-notice", "distributed under the boost software license version 1 0"),
    ("boost-title", "boost software license version 1 0 august 17th 2003"),
    ("bsd-intro", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-advert", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0-waiver", "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("cddl-terms", "the contents of this file are subject to the terms of the common development and distribution license the license"),
    ("epl1-terms", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html"),
    ("epl2-terms", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("gpl-free", "this program is free software"),
    ("gpl-terms", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl2-later", "either version 2 of the license or at your option any later version"),
    ("gpl2-only", "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl2-work", "this work is licensed under the gnu general public license version 2"),
    ("gpl3-only", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license"),
    ("gpl3-terms", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl3-work", "this work is licensed under the gnu general public license version 3"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl-free", "this library is free software"),
    ("lgpl-terms", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl21-later", "either version 2 1 of the license or at your option any later version"),
    ("lgpl21-only", "you can redistribute it and or modify it under the terms of the gnu lesser general public license version 2 1 as published by the free software foundation"),
    ("lgpl3-later", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mit-released", "released under the mit license"),
    ("mit-licensed", "licensed under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit0-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("mpl2-form", "this source code form is subject to the terms of the mozilla public license v"),
    ("mpl2-copy", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("mpl2-copy-https", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("ofl-notice", "this font software is licensed under the sil open font license version 1 1"),
    ("postgres-grant", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"),
    ("unlicense-free", "this is free and unencumbered software released into the public domain"),
    ("wtfpl-terms", "you can redistribute it and or modify it under the terms of the do what the fuck you want to public license version 2 as published by sam hocevar"),
    ("zero-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
)
#: Identifiers of licences that a tag may name.
TAGS = ("0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "MS-PL", "OFL-1.1", "PSF-2.0", "PostgreSQL", "Unlicense", "WTFPL", "Zlib")
_TAG = "spdx license identifier"
SENTENCES = (*NOTICES, *((f"spdx-{t.lower()}", f"{_TAG} {' '.join(t.lower().replace('.', '-').split('-'))}") for t in TAGS))
#: Every known sentence holds one of these, each within a word: signs and spaces between words vary.
CUES = ("licen", "copyright", "software", "mozilla", "redistribution")
#: Licence and the ordered sentences that show it.
NOTICE_RULES = (
    ("0BSD", ("zero-grant",)),
    ("AGPL-3.0-only", ("gpl-free", "agpl3-only")),
    ("AGPL-3.0-only", ("gpl-free", "agpl3-only-the")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl3-later")),
    ("Apache-2.0", ("apache-notice-the", "apache-compliance", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-notice-the", "apache-compliance")),
    ("Apache-2.0", ("apache-notice-the",)),
    ("Apache-2.0", ("apache-notice",)),
    ("BSD-2-Clause", ("bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-4-Clause", ("bsd-source", "bsd-binary", "bsd-advert")),
    ("BSD-4-Clause", ("bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse")),
    ("BSL-1.0", ("boost-notice",)),
    ("BSL-1.0", ("boost-title",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC0-1.0", ("cc0-waiver",)),
    ("CDDL-1.0", ("cddl-terms",)),
    ("EPL-1.0", ("epl1-terms",)),
    ("EPL-2.0", ("epl2-terms",)),
    ("GPL-2.0-only", ("gpl-free", "gpl2-only")),
    ("GPL-2.0-only", ("gpl2-work",)),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-terms", "gpl2-later")),
    ("GPL-3.0-only", ("gpl-free", "gpl3-only")),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-terms")),
    ("ISC", ("isc-grant",)),
    ("LGPL-2.1-only", ("lgpl-free", "lgpl21-only")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-terms", "lgpl21-later")),
    ("LGPL-3.0-or-later", ("gpl-free", "lgpl3-later")),
    ("LGPL-3.0-or-later", ("lgpl-free", "lgpl3-later")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-released",)),
    ("MIT-0", ("mit0-grant",)),
    ("MPL-2.0", ("mpl2-form", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-form", "mpl2-copy-https")),
    ("OFL-1.1", ("ofl-notice",)),
    ("PostgreSQL", ("postgres-grant",)),
    ("Unlicense", ("unlicense-free",)),
    ("WTFPL", ("gpl-free", "wtfpl-terms")),
    ("Zlib", ("zlib-grant",)),
)
RULES = (*NOTICE_RULES, *((t, (f"spdx-{t.lower()}",)) for t in TAGS))


def rule_pattern(ids: tuple[str, ...]) -> str:
    return f"(?:-,){{0,{GAP}}}".join(f"{i.replace('.', '[.]')}," for i in ids)


def _longest_first() -> list[tuple[str, str]]:
    return [(name, rule_pattern(ids)) for name, ids in sorted(RULES, key=lambda r: -len(r[1]))]


#: Between sentences, and between lines that may be of one.
HARD, SOFT = "\x01", "\x02"
TAG_COLON = r"(spdx-license-identifier):[ \t]*"


def units(text: Column) -> Column:
    """The known sentences and the other lines of a text, normalised, each with the ``HARD`` or ``SOFT`` after it."""
    cut = F.regexp_replace(F.translate(F.lower(text), HARD + SOFT, "  "), TAG_COLON, "$1 ")
    cut = F.regexp_replace(cut, r"[.!?;:][ \t\r\n]+", HARD)
    cut = F.regexp_replace(cut, rf"\n[^\p{{L}}\p{{N}}{HARD}]*\n", HARD)
    cut = F.regexp_replace(F.translate(cut, "\n", SOFT), rf"[^\p{{L}}\p{{N}}{HARD}{SOFT}]+", " ")
    cut = F.regexp_replace(cut, rf"[ {SOFT}]*{HARD}[ {HARD}{SOFT}]*", HARD)
    cut = F.regexp_replace(cut, rf" *{SOFT}[ {SOFT}]*", SOFT)
    cut = F.regexp_replace(cut, rf"^[ {HARD}{SOFT}]+|[ {HARD}{SOFT}]+$", "")
    known = "|".join(s.replace(" ", f"[ {SOFT}]") for _, s in sorted(SENTENCES, key=lambda x: -len(x[1])))
    return F.regexp_extract_all(cut, F.lit(rf"(?:(?:{known})(?=[{HARD}{SOFT}]|$)|[^{HARD}{SOFT}]+)[{HARD}{SOFT}]?"), F.lit(0))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_known, known (identifiers in order) and licenses (in order).

    Columns of these names are replaced.
    """
    line_name = free_name(docs, "line")
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    cued = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(c)) for c in CUES])
    table_ = F.create_map(*[F.lit(x) for i, s in SENTENCES for x in (s, i)])

    def name(unit: Column) -> Column:
        """An identifier or ``-`` with a comma, ``~`` for an unknown line that the next may go on."""
        known = F.try_element_at(table_, F.trim(F.translate(unit, HARD + SOFT, "  ")))
        return F.when(known.isNotNull(), F.concat(known, F.lit(","))).when(F.endswith(unit, F.lit(SOFT)), F.lit("~")).otherwise(F.lit("-,"))

    names = F.regexp_replace(F.array_join(F.transform(units(F.col(text)), name), ""), "~+(?:-,)?", "-,")
    line = F.when(cued, F.concat(F.lit(","), names)).otherwise(F.lit(","))
    rules = _longest_first()
    matches = F.regexp_extract_all(F.col(line_name), F.lit("(?<=,)(?:" + "|".join(f"(?:{p})" for _, p in rules) + ")"), F.lit(0))

    named = F.create_map(*[F.lit(x) for n, ids in RULES for x in ("".join(f"{i}," for i in ids), n)])
    licence = lambda m: F.element_at(named, F.regexp_replace(m, "(?<=,)-,", ""))
    known = F.filter(F.split(F.col(line_name), ","), lambda x: (x != "") & (x != "-"))
    return docs.withColumn(line_name, line).withColumns({"n_known": F.size(known).cast("long"), "known": F.array_join(known, ","), "licenses": F.array_join(F.transform(matches, licence), ",")}).drop(line_name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _oracle() -> str:
    known = ", ".join(f"('{s}', '{i}')" for i, s in SENTENCES)
    rules = _longest_first()
    pattern = "|".join(f"(?:{p})" for _, p in rules)
    lowered = f"regexp_replace(lower(coalesce(text, '')), '{TAG_COLON}', '\\1 ', 'g')"
    case = " ".join(f"WHEN regexp_full_match(m, '{p}') THEN '{n}'" for n, p in rules)
    return f"""
WITH known(sentence, name) AS (VALUES {known}),
cut AS (
  SELECT doc_id, unnest(string_split(regexp_replace({lowered}, '([.!?;:])[ \\t\\r]+', '\\1\n', 'g'), '\n')) AS s,
    generate_subscripts(string_split(regexp_replace({lowered}, '([.!?;:])[ \\t\\r]+', '\\1\n', 'g'), '\n'), 1) AS i
  FROM documents
), named AS (
  SELECT doc_id, i, coalesce(name, '-') AS name
  FROM (SELECT doc_id, i, trim(regexp_replace(s, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS s FROM cut) c LEFT JOIN known ON s = sentence
  WHERE s <> ''
), line AS (
  SELECT d.doc_id, coalesce(string_agg(n.name || ',', '' ORDER BY n.i), '') AS line,
    count(*) FILTER (WHERE n.name <> '-') AS n_known,
    coalesce(string_agg(n.name, ',' ORDER BY n.i) FILTER (WHERE n.name <> '-'), '') AS known
  FROM documents d LEFT JOIN named n ON n.doc_id = d.doc_id GROUP BY d.doc_id
)
SELECT doc_id, n_known, known,
  list_aggregate(list_transform(regexp_extract_all(line, '\\b(?:{pattern})'), lambda m: CASE {case} END), 'string_agg', ',') AS licenses
FROM line
"""


ORACLE_SQL = _oracle().replace("list_aggregate(", "coalesce(list_aggregate(", 1).replace("'string_agg', ',') AS licenses", "'string_agg', ','), '') AS licenses")
