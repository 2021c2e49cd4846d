"""License scans by sentence rules, with built-in functions only.

A text is cut into sentences, each is normalised (A-Z lower-cased, runs of other
characters than a-z and 0-9 become one space), and looked up among the known licence
sentences. The identifiers found, in text order, make a sequence; the licence rules,
in their own order, are regular expressions over it. The first rule that fits names
the document's licence; all that fit are listed.

A line break inside a known sentence does not end it, whatever stands after the break:
capitals, brackets, comment marks. Other line breaks do, but before a-z.

Only texts that hold one of a few anchor words are cut up; every known sentence has
an anchor (a test holds that), so no sentence is missed. Nothing is shuffled or
broadcast: sentences and rules are literals of the plan, Catalyst keeps one pass.

A null or empty text has no sentences, no licences and a null licence. Repeated rows
give repeated rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Known licence sentences by identifier (fixed values).
SENTENCES: dict[str, tuple[str, ...]] = {
    "apache2-grant": ("Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    "apache2-use": ("you may not use this file except in compliance with the License",),
    "apache2-copy": ("You may obtain a copy of the License at",),
    "apache2-asis": ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",),
    "mit-release": ("Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License"),
    "mit-grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "gpl3-work": ("This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3"),
    "gpl2-work": ("This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2"),
    "gpl-free": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "gpl-nowarranty": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    "gpl-terms": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",),
    "gpl2-terms": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",),
    "lgpl-terms": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "lgpl3-terms": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "agpl3-terms": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "later-2": ("either version 2 of the License, or (at your option) any later version",),
    "later-2.1": ("either version 2.1 of the License, or (at your option) any later version",),
    "later-3": ("either version 3 of the License, or (at your option) any later version",),
    "lgpl-work": ("Licensed under the GNU Lesser General Public License, version 3", "Licensed under the GNU Lesser General Public License, version 2.1"),
    "mpl2": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, Version 2.0"),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    "bsd-endorse": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    "0bsd-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "zlib-grant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
    "epl2": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https:", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http:"),
    "cc-by": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc0": ("Dedicated to the public domain under CC0 1.0", "Licensed under CC0 1.0"),
    "all-rights": ("All rights reserved",),
}

#: Published sentences of which SENTENCES has the start only (fixed values).
PUBLISHED: dict[str, tuple[str, ...]] = {
    "mit-grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",),
}

#: Licences in the order in which their sequences are tried: each sequence names the
#: sentences that must follow one another, others may stand between (fixed values).
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache2-grant", "apache2-use", "apache2-copy", "apache2-asis")),
    ("Apache-2.0", ("apache2-grant",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-release",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-nowarranty")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0-or-later", ("gpl-terms", "later-3")),
    ("GPL-2.0-or-later", ("gpl-terms", "later-2")),
    ("GPL-2.0-only", ("gpl2-terms",)),
    ("AGPL-3.0-or-later", ("agpl3-terms",)),
    ("LGPL-3.0-or-later", ("lgpl3-terms",)),
    ("LGPL-3.0-or-later", ("lgpl-terms", "later-3")),
    ("LGPL-2.1-or-later", ("lgpl-terms", "later-2.1")),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("GPL-2.0-only", ("gpl2-work",)),
    ("LGPL", ("lgpl-work",)),
    ("MPL-2.0", ("mpl2",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("Zlib", ("zlib-grant",)),
    ("EPL-2.0", ("epl2",)),
    ("Unlicense", ("unlicense",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC0-1.0", ("cc0",)),
    ("Proprietary", ("all-rights",)),
)

#: Each known sentence holds one of these, in any case (fixed values).
ANCHORS = ("licen", "rights reserved", "copyright", "permission", "warrant", "redistribut", "public domain", "compliance with")

#: Words that start an address (fixed values).
ADDRESS = ("http", "https")

#: What ends a sentence, and a line break that only wraps one.
WRAP, END = r"\n[ \t]*([a-z])", r"[.!?;]+([\x20\x09-\x0D]|\z)|[:\n\r]+"


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def known(sentences: dict[str, tuple[str, ...]] = SENTENCES) -> dict[str, str]:
    """Identifier by normalised sentence, after the cuts that the text gets too."""
    out = {}
    for name, variants in sentences.items():
        for v in variants:
            cut = re.split(END.replace(r"\z", r"\Z"), v)
            longest = max((normalised(x or "") for x in cut), key=len)
            out[longest] = name
    return out


def inner_break() -> str:
    """What matches a line break, with the comment marks after it, between two words that
    stand side by side in a known sentence. A word that starts a known sentence counts
    only as it is written inside one, so that no sentence is drawn to the line before."""
    written = [re.findall("[A-Za-z0-9]+", v) for d in (SENTENCES, PUBLISHED) for variants in d.values() for v in variants]
    cut = [k.split() for d in (SENTENCES, PUBLISHED) for k in known(d)]
    inside, starts = {w for words in written for w in words[1:]}, {words[0] for words in cut}
    before: dict[str, set[str]] = {}
    for words in cut:
        for one, two in zip(words, words[1:]):
            if two in ADDRESS:  # one on a line of its own belongs to no sentence
                continue
            before.setdefault(two, set()).add(one)
    ways = []
    for two, ones in sorted(before.items()):
        form = f"(?-i:{'|'.join(sorted(w for w in inside if w.lower() == two))})" if two in starts else two
        ways.append(rf"(?<=\b(?:{'|'.join(sorted(ones))})[^A-Za-z0-9\r\n]{{0,4}}[\r\n]{{1,2}})[^A-Za-z0-9\r\n]{{0,12}}(?={form}\b)")
    return rf"(?i)(?:\r\n?|\n)(?:{'|'.join(ways)})"


def rule_pattern(sequence: tuple[str, ...]) -> str:
    """A regular expression over ``,id,id,`` that lets other ids stand between."""
    return ",(.*,)?".join(re.escape(s).replace(r"\-", "-") for s in sequence).join((",", ","))


def sequence_of(text: Column, sentences: dict[str, tuple[str, ...]] = SENTENCES, anchors: tuple[str, ...] = ANCHORS) -> Column:
    """The known sentences' identifiers in text order."""
    lookup = known(sentences) | (known(PUBLISHED) if sentences is SENTENCES else {})
    ids = F.create_map(*(F.lit(x) for pair in lookup.items() for x in pair))
    flat = F.regexp_replace(F.regexp_replace(text, inner_break(), " "), WRAP, " $1")
    cut = F.split(F.regexp_replace(flat, END, "\n"), "\n")
    found = F.transform(cut, lambda s: ids[F.trim(F.regexp_replace(common.ascii_lower(s), "[^a-z0-9]+", " "))])
    anchored = text.rlike("(?i)" + "|".join(anchors))
    return F.when(anchored, F.filter(found, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The operator: key, n_sentences, sentence_ids and licences (comma-separated,
    in text and in rule order), and licence (the first rule's, or null)."""
    texts = df.select(F.col(key), sequence_of(F.col(text).cast("string")).alias("__ids"))
    joined = F.concat(F.lit(","), F.array_join("__ids", ","), F.lit(","))
    rules = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(rule_pattern(s)).alias("pattern")) for n, s in RULES))
    fits = F.array_distinct(F.transform(F.filter(rules, lambda r: F.rlike(joined, r["pattern"])), lambda r: r["name"]))
    fits = F.when(F.size("__ids") > 0, fits).otherwise(F.array().cast("array<string>"))
    return texts.select(
        F.col(key),
        F.coalesce(F.size("__ids"), F.lit(0)).cast("long").alias("n_sentences"),
        F.coalesce(F.array_join("__ids", ","), F.lit("")).alias("sentence_ids"),
        F.coalesce(F.array_join(fits, ","), F.lit("")).alias("licences"),
        F.try_element_at(fits, F.lit(1)).alias("licence"),
    )


def scan_sql(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """The same for DuckDB, but for PUBLISHED sentences and breaks that only
    ``inner_break`` joins (RE2 cannot look around)."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    ids = known()
    rules = ", ".join(f"{{'name': {quote(n)}, 'pattern': {quote(rule_pattern(s))}}}" for n, s in RULES)
    return f"""
with cut as (
    select {key}, string_split(regexp_replace(regexp_replace({text}, {quote(WRAP)}, ' \\1', 'g'), {quote(END)}, chr(10), 'g'), chr(10)) as sentences
    from {table}),
ids as (
    select {key}, coalesce(list_filter(list_transform(sentences, lambda s: map {{{', '.join(f'{quote(k)}: {quote(v)}' for k, v in ids.items())}}}[
        trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))]), lambda x: x is not null), []) as ids
    from cut),
fits as (
    select {key}, ids, list_transform(list_filter([{rules}], lambda r: regexp_matches(',' || array_to_string(ids, ',') || ',', r.pattern)), lambda r: r.name) as fits from ids)
select {key}, len(ids)::bigint as n_sentences, array_to_string(ids, ',') as sentence_ids,
       coalesce(array_to_string(list_filter(fits, lambda x, i: list_position(fits, x) = i), ','), '') as licences, fits[1] as licence
from fits"""
