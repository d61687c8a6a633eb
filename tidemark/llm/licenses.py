"""License scans: ordered signature rules with keyword gates, priorities and interval containment.

Only DataFrame functions; rules run over the normalised words of a text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, staged

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` matches whole words parted by single blanks.  It is tried only where the text has a word
    of ``gate`` (parted by ``|``; every match holds one) and the string ``keyword``.  Higher ``priority`` wins; ``confidence`` goes into the score."""

    label: str
    pattern: str
    gate: str
    keyword: str
    priority: int
    confidence: float
    base: bool = False


# Names of licenses as they read in normalised words: label, pattern of the name, a string it cannot do without.
# Written for this scanner; longer and more exact names come before shorter ones of the same family.
_NAMES = [
    ("apache-2.0", r"apache(?: software)?(?: license)?(?: version)?(?: v)? ?v?2(?: 0)?", "apache"),
    ("apache-1.1", r"apache(?: software)?(?: license)?(?: version)? 1 1", "apache"),
    ("apache-1.0", r"apache(?: software)?(?: license)?(?: version)? 1 0", "apache"),
    ("apache", r"apache(?: software)?", "apache"),
    ("mit-0", r"mit(?: license)? (?:0|no attribution)", "mit"),
    ("mit", r"(?:mit|x11|expat)", ""),
    ("bsd-2-clause", r"(?:simplified|freebsd|2 clause|two clause) ?(?:bsd)?|bsd 2 clause", ""),
    ("bsd-3-clause", r"(?:new|modified|revised|3 clause|three clause) bsd|bsd 3 clause", "bsd"),
    ("bsd-4-clause", r"(?:original|4 clause|four clause) bsd|bsd 4 clause", "bsd"),
    ("bsd-0-clause", r"(?:zero clause|0 clause) bsd|0bsd", "bsd"),
    ("bsd", r"bsd", "bsd"),
    ("isc", r"isc", "isc"),
    ("agpl-3.0", r"(?:gnu )?(?:affero general public license|agpl)(?: version)?(?: v)? ?v?3(?: 0)?", ""),
    ("agpl", r"(?:gnu )?affero general public license|agpl", ""),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser general public license|lgpl)(?: version)?(?: v)? ?v?2 1", ""),
    ("lgpl-3.0", r"(?:gnu )?(?:lesser general public license|lgpl)(?: version)?(?: v)? ?v?3(?: 0)?", ""),
    ("lgpl-2.0", r"(?:gnu )?(?:library general public license|lgpl)(?: version)?(?: v)? ?v?2(?: 0)?", ""),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public license|lgpl", ""),
    ("gpl-3.0", r"(?:gnu )?(?:general public license|gpl)(?: version)?(?: v)? ?v?3(?: 0)?", ""),
    ("gpl-2.0", r"(?:gnu )?(?:general public license|gpl)(?: version)?(?: v)? ?v?2(?: 0)?", ""),
    ("gpl-1.0", r"(?:gnu )?(?:general public license|gpl)(?: version)?(?: v)? ?v?1(?: 0)?", ""),
    ("gpl", r"(?:gnu )?general public license|(?:gnu )?gpl", ""),
    ("gfdl-1.3", r"(?:gnu )?free documentation license(?: version)? 1 3", "documentation"),
    ("gfdl", r"(?:gnu )?free documentation license|gfdl", ""),
    ("mpl-2.0", r"(?:mozilla public license|mpl)(?: version)?(?: v)? ?v?2(?: 0)?", ""),
    ("mpl-1.1", r"(?:mozilla public license|mpl)(?: version)?(?: v)? ?v?1 1", ""),
    ("mpl", r"mozilla public license|mpl", ""),
    ("epl-2.0", r"(?:eclipse public license|epl)(?: version)?(?: v)? ?v?2(?: 0)?", ""),
    ("epl-1.0", r"(?:eclipse public license|epl)(?: version)?(?: v)? ?v?1(?: 0)?", ""),
    ("epl", r"eclipse public license", "eclipse"),
    ("eupl-1.2", r"(?:european union public licence|eupl)(?: version)?(?: v)? ?v?1 2", ""),
    ("eupl", r"european union public licence|eupl", ""),
    ("cddl-1.0", r"(?:common development and distribution license|cddl)(?: version)?(?: 1 0)?", ""),
    ("cpl-1.0", r"common public license(?: version)?(?: 1 0)?", "common"),
    ("artistic-2.0", r"artistic license(?: version)? 2(?: 0)?", "artistic"),
    ("artistic", r"artistic license", "artistic"),
    ("zlib", r"zlib(?: libpng)?", "zlib"),
    ("boost-1.0", r"boost software license(?: version)?(?: 1 0)?|bsl 1 0", ""),
    ("unlicense", r"unlicense", "unlicense"),
    ("wtfpl", r"wtfpl|do what the fuck you want to public license", ""),
    ("cc0-1.0", r"cc0(?: 1 0)?(?: universal)?|cc zero(?: 1 0)?", ""),
    ("cc-by-nc-nd-4.0", r"cc by nc nd 4 0", "nc nd"),
    ("cc-by-nc-sa-4.0", r"cc by nc sa 4 0", "nc sa"),
    ("cc-by-nc-4.0", r"cc by nc 4 0", "by nc"),
    ("cc-by-nd-4.0", r"cc by nd 4 0", "by nd"),
    ("cc-by-sa-4.0", r"cc by sa 4 0", "by sa"),
    ("cc-by-4.0", r"cc by 4 0", "by 4"),
    ("cc-by-nc-nd-3.0", r"cc by nc nd 3 0", "nc nd"),
    ("cc-by-nc-sa-3.0", r"cc by nc sa 3 0", "nc sa"),
    ("cc-by-nc-3.0", r"cc by nc 3 0", "by nc"),
    ("cc-by-nd-3.0", r"cc by nd 3 0", "by nd"),
    ("cc-by-sa-3.0", r"cc by sa 3 0", "by sa"),
    ("cc-by-3.0", r"cc by 3 0", "by 3"),
    ("cc-by-nc-nd", r"cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s", ""),
    ("cc-by-nc-sa", r"cc by nc sa|creative commons attribution non ?commercial share ?alike", ""),
    ("cc-by-nc", r"cc by nc|creative commons attribution non ?commercial", ""),
    ("cc-by-sa", r"cc by sa|creative commons attribution share ?alike", ""),
    ("cc-by-nd", r"cc by nd|creative commons attribution no ?deriv(?:ative)?s", ""),
    ("cc-by", r"cc by|creative commons attribution", ""),
    ("odbl-1.0", r"open database license(?: 1 0)?|odbl(?: 1 0)?", ""),
    ("odc-by", r"open data commons attribution license|odc by", ""),
    ("ogl", r"open government licence(?: v?\d(?: 0)?)?", "government"),
    ("ofl-1.1", r"(?:sil )?open font license(?: version)?(?: 1 1)?", "font"),
    ("openssl", r"openssl", "openssl"),
    ("php-3.01", r"php license(?: version)?(?: 3 0?1)?", "php"),
    ("psf-2.0", r"python software foundation license(?: version)?(?: 2)?|psf license", ""),
    ("ms-pl", r"microsoft public license|ms pl", ""),
    ("ms-rl", r"microsoft reciprocal license|ms rl", ""),
]

# How a license is named in a text: a pattern around the name, the gate words, priority, confidence.
_PHRASES = [
    (r"spdx license identifier (?:{})", "spdx", 90, 1.0),
    (r"licen[sc]ed (?:to you )?under (?:the )?(?:terms of )?(?:the )?(?:{})(?: licen[sc]e)?", "licensed|licenced", 80, 0.95),
    (r"(?:released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:{})(?: licen[sc]e)?",
     "under", 70, 0.9),
    (r"(?:subject to|governed by) (?:the )?(?:terms of )?(?:the )?(?:{})(?: licen[sc]e)?", "subject|governed", 60, 0.8),
    (r"(?:the )?(?:{}) licen[sc]e", "license|licence", 40, 0.6),
]

# Notices that name no license of the table.
_NOTICES = [
    Rule("copyright-notice", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?", "copyright", "copyright", 30, 0.3),
    Rule("public-domain", r"(?:released|dedicated|placed) (?:in)?to the public domain", "public", "public domain", 60, 0.8),
    Rule("public-domain", r"in the public domain", "public", "public domain", 40, 0.5),
    Rule("proprietary", r"proprietary and confidential", "confidential", "proprietary", 60, 0.8),
    Rule("proprietary", r"unauthori[sz]ed (?:copying|use|reproduction)(?: or distribution)? (?:of this \w+ )?is (?:strictly )?prohibited",
         "unauthorized|unauthorised", "prohibited", 60, 0.8),
    Rule("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "permission", "hereby", 90, 0.95),
    Rule("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission", "distribute", 90, 0.95),
    Rule("bsd", r"redistribution and use in source and binary forms", "redistribution", "binary", 85, 0.9),
    Rule("warranty-disclaimer", r"provided as is without warranty of any kind", "warranty", "as is", 30, 0.3),
    Rule("warranty-disclaimer", r"without warranties or conditions of any kind", "warranties", "conditions", 30, 0.3),
]

# Sentences and titles by which licenses are known, as they read in normalised words, and words that may vary in them.
# Written for this scanner: label, priority, confidence, then one signature a line.
_TEXTS = """
apache-2.0 85 0.95
you may not use this file except in compliance with the license
you may obtain a copy of the license at http www apache org licenses license 2 0
unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
see the license for the specific language governing permissions and limitations under the license
licensed to the apache software foundation asf under one or more contributor license agreements
terms and conditions for use reproduction and distribution
grant of patent license subject to the terms and conditions of this license
mit 85 0.95
to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
in no event shall the authors or copyright holders be liable for any claim damages or other liability
use of this source code is governed by an? mit style license
this (?:project|program|library|module|code) is licensed under the terms of the mit license
mit-0 88 0.95
permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
bsd-3-clause 85 0.95
neither the name of [a-z0-9 ]{1,80}? nor the names of its contributors may be used to endorse or promote products derived from this software
use of this source code is governed by a bsd style license that can be found in the license file
bsd-2-clause 82 0.9
redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
this software is provided by the copyright holders and contributors as is and any express or implied warranties
bsd-4-clause 86 0.95
all advertising materials mentioning features or use of this software must display the following acknowledgement
isc 85 0.95
permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
the software is provided as is and the author disclaims all warranties with regard to this software
gpl-2.0 85 0.95
gnu general public license version 2 june 1991
either version 2 of the license or at your option any later version
under the terms of the gnu general public license version 2 as published by the free software foundation
free software foundation inc 51 franklin street fifth floor boston ma 02110 1301
free software foundation inc 59 temple place
you should have received a copy of the gnu general public license along with this program if not write to the free software foundation
gpl-3.0 85 0.95
gnu general public license version 3 29 june 2007
either version 3 of the license or at your option any later version
you should have received a copy of the gnu general public license along with this program if not see
the gnu general public license is a free copyleft license for software and other kinds of works
gpl 75 0.85
this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
this program is distributed in the hope that it will be useful but without any warranty
without even the implied warranty of merchantability or fitness for a particular purpose
as a special exception the copyright holders give permission to link
lgpl-2.1 85 0.95
gnu lesser general public license version 2 1 february 1999
either version 2 1 of the license or at your option any later version
lgpl-3.0 85 0.95
gnu lesser general public license version 3 29 june 2007
this version of the gnu lesser general public license incorporates the terms and conditions of version 3
lgpl 76 0.85
this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
you should have received a copy of the gnu lesser general public license along with this library
lgpl-2.0 85 0.95
gnu library general public license version 2 june 1991
agpl-3.0 85 0.95
gnu affero general public license version 3 19 november 2007
you should have received a copy of the gnu affero general public license along with this program
it under the terms of the gnu affero general public license as published by the free software foundation
gfdl 80 0.9
permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
with no invariant sections no front cover texts and no back cover texts
mpl-2.0 85 0.95
this source code form is subject to the terms of the mozilla public license v 2 0
if a copy of the mpl was not distributed with this file you can obtain one at
this source code form is incompatible with secondary licenses as defined by the mozilla public license
mpl-1.1 85 0.95
the contents of this file are subject to the mozilla public license version 1 1
software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied
epl-2.0 85 0.95
this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
epl-1.0 85 0.95
the accompanying materials are made available under the terms of the eclipse public license v1 0
the accompanying program is provided under the terms of this eclipse public license
cpl-1.0 85 0.95
the accompanying program is provided under the terms of this common public license
cddl-1.0 85 0.95
the contents of this file are subject to the terms of the common development and distribution license
eupl 84 0.9
licensed under the eupl version 1 [12] or as soon they will be approved by the european commission
artistic-2.0 84 0.9
this license establishes the terms under which a given free software package may be copied modified distributed
artistic 80 0.85
the intent of this document is to state the conditions under which a package may be copied
zlib 85 0.95
this software is provided as is without any express or implied warranty in no event will the authors be held liable
permission is granted to anyone to use this software for any purpose including commercial applications
the origin of this software must not be misrepresented you must not claim that you wrote the original software
altered source versions must be plainly marked as such and must not be misrepresented as being the original software
boost-1.0 85 0.95
permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
distributed under the boost software license version 1 0
unlicense 85 0.95
this is free and unencumbered software released into the public domain
anyone is free to copy modify publish use compile sell or distribute this software
wtfpl 85 0.95
you just do what the fuck you want to
cc0-1.0 85 0.95
the person who associated a work with this deed has dedicated the work to the public domain by waiving all
to the extent possible under law [a-z0-9 ]{1,60}? has waived all copyright and related or neighboring rights
creative commons cc0 1 0 universal
cc-by 65 0.8
this work is licensed under a creative commons attribution [1-4] [05] (?:international|unported|generic) license
you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-sa 66 0.8
this work is licensed under a creative commons attribution sharealike [1-4] [05] (?:international|unported|generic) license
if you remix transform or build upon the material you must distribute your contributions under the same license as the original
cc-by-nc 66 0.8
this work is licensed under a creative commons attribution noncommercial [1-4] [05] (?:international|unported|generic) license
you may not use the material for commercial purposes
cc-by-nc-sa 67 0.8
this work is licensed under a creative commons attribution noncommercial sharealike [1-4] [05] (?:international|unported|generic) license
cc-by-nc-nd 67 0.8
this work is licensed under a creative commons attribution noncommercial noderivatives [1-4] [05] (?:international|unported|generic) license
cc-by-nd 66 0.8
if you remix transform or build upon the material you may not distribute the modified material
odbl-1.0 84 0.9
any rights in individual contents of the database are licensed under the database contents license
this database is made available under the open database license
ogl 84 0.9
contains public sector information licensed under the open government licence
you are free to copy publish distribute and transmit the information
ofl-1.1 85 0.95
this font software is licensed under the sil open font license version 1 1
the font software may be sold as part of a larger software package but no copy of one or more of the font typefaces may be sold by itself
openssl 85 0.95
this product includes software developed by the openssl project for use in the openssl toolkit
php-3.01 85 0.95
this product includes php software freely available from http www php net software
psf-2.0 85 0.95
the psf is making python available to licensee on an as is basis
ms-pl 84 0.9
this license governs use of the accompanying software if you use the software you accept this license
postgresql 85 0.95
permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
hpnd 84 0.9
permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appear in all copies
ncsa 85 0.95
university of illinois ncsa open source license
vim 80 0.85
vim is charityware you can use and copy it as much as you like
json 85 0.95
the software shall be used for good not evil
beerware 85 0.95
if we meet some day and you think this stuff is worth it you can buy me a beer in return
ruby 80 0.85
you can redistribute it and or modify it under either the terms of the 2 clause bsdl
w3c 84 0.9
permission to copy modify and distribute this software and its documentation with or without modification for any purpose and without fee or royalty is hereby granted
unicode 85 0.95
permission is hereby granted free of charge to any person obtaining a copy of the unicode data files and any associated documentation
icu 80 0.85
icu license icu 1 8 1 and later
curl 85 0.95
permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
libpng 84 0.9
the contributing authors and group 42 inc disclaim all warranties expressed or implied
ijg 85 0.95
this software is based in part on the work of the independent jpeg group
freetype 84 0.9
portions of this software are copyright [0-9 ]{0,20}?the freetype project
imagemagick 84 0.9
licensed under the imagemagick license
afl-3.0 84 0.9
licensed under the academic free license version 3 0
osl-3.0 84 0.9
licensed under the open software license version 3 0
bsl-1.1 85 0.95
business source license 1 1
the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
sspl-1.0 85 0.95
server side public license version 1 october 16 2018
if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available
elastic-2.0 85 0.95
you may not provide the software to third parties as a hosted or managed service
commons-clause 85 0.95
the grant of rights under the license will not include and the license does not grant to you the right to sell the software
rail 84 0.9
you agree not to use the model or derivatives of the model
bigscience openrail m license
llama-community 85 0.95
llama [0-9] (?:[0-9] )?community license agreement
proprietary 62 0.8
no part of this (?:publication|document|book|work) may be reproduced stored in a retrieval system or transmitted
reproduction in whole or in part without (?:written )?permission is (?:strictly )?prohibited
this software is the confidential and proprietary information of
licensed materials property of ibm
for internal use only
you may not decompile reverse engineer or disassemble the software
this material may not be published broadcast rewritten or redistributed
patent-grant 50 0.6
perpetual worldwide non exclusive no charge royalty free irrevocable patent license
contributor-agreement 50 0.6
you represent that you are legally entitled to grant the above license
no-liability 30 0.3
in no event shall the copyright (?:owner|holder)s? or contributors be liable for any direct indirect incidental special exemplary or consequential damages
to the maximum extent permitted by (?:applicable )?law
the entire risk as to the quality and performance of the program is with you
educational-use 60 0.8
for (?:academic|educational|research) (?:use|purposes) only
for non ?commercial (?:use|purposes) only
government-use 50 0.6
use duplication or disclosure by the (?:u s )?government is subject to restrictions
source-available 50 0.6
this source code is (?:made )?available for reference (?:purposes )?only
fair-use 40 0.5
this (?:site|page|article) (?:may contain|contains) copyrighted material the use of which has not always been specifically authorized
attribution-required 50 0.6
you are free to use this (?:work|image|photo|text) as long as you credit the author
copying-permitted 50 0.6
copying and distribution of this file with or without modification are permitted in any medium without royalty
permission is granted to make and distribute verbatim copies of this manual
this file is free software the author gives unlimited permission to copy and or distribute it
"""

# The first of these words that a signature holds opens it.
_OPENERS = ("license licence licensed licenses permission redistributions warranty warranties copyright copyrighted public "
            "reproduced confidential software prohibited permitted rights right material warranty database free only program "
            "model distributed liable purposes beer law government credit information work font copy service distribution products "
            "sections document commons python modify want agreement").split()


_VARYING = re.compile(r"\((?:[^()]|\([^()]*\))*\)\??(?:s\?)?|\[[^\]]*\](?:\{[^}]*\}\??)?|\S+ \?\S+")


def _signatures() -> list[Rule]:
    out, label, priority, confidence = [], "", 0, 0.0
    for line in _TEXTS.strip().split("\n"):
        if re.fullmatch(r"[a-z0-9.-]+ \d\d 0\.\d+", line):
            label, priority, confidence = line.split()
            continue
        # words that no varying part touches can't be missing
        rows = [[w for w in part.split() if "?" not in w] for part in _VARYING.split(line)]
        gate, fixed = next((w, row) for w in _OPENERS for row in rows if w in row)
        at = fixed.index(gate)
        out.append(Rule(label, line, gate, " ".join(fixed[max(0, at - 1):at + 2]), int(priority), float(confidence)))
    return out


_BASE = [
    Rule("cc-by", r"cc by", "cc", "cc by", 10, 0.5, True),
    Rule("gpl", r"general public license", "public", "general public license", 10, 0.5, True),
    Rule("reserved", r"all rights reserved", "reserved", "all rights reserved", 10, 0.5, True),
]

#: In the order in which they take precedence at equal priority and extent.
RULES: list[Rule] = _BASE + [
    Rule(label, phrase.format(name), gate, keyword, priority, confidence)
    for phrase, gate, priority, confidence in _PHRASES for label, name, keyword in _NAMES] + _NOTICES + _signatures()

#: Parts matches from the text between them; it is white space, so no normalised text has it.
_MARK = "\x01"


def _n_words(part: Column) -> Column:
    return F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections) of every row.

    Words are runs of ASCII digits and letters, lower-cased, and of all other characters beyond ASCII.  A
    detection is dropped if it lies inside another of higher priority, or of equal priority and earlier rule or
    greater extent; base rules are never dropped.  ``score`` is the best confidence left, 0 without any.  Null text
    has no words; rows are independent, equal ids stay apart; other columns are ignored.

    A text is normalised once and searched once for all gate words; rules run only where their gate and keyword
    are.  Places of matches are narrow rows, so windows over them hold one text's detections.
    """
    opened = {}
    for r in rules:
        for word in r.gate.split("|"):
            opened.setdefault(word, set()).add(r.gate)
    gates = "|".join(sorted(opened))
    gates_of = F.create_map(*[c for word in sorted(opened) for c in (
        F.lit(word), F.array(*map(F.lit, sorted(opened[word]))))])
    table = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(r.gate).alias("gate"), F.lit(r.keyword).alias("keyword"),
                               F.lit(f"(?<= )(?:{r.pattern})(?= )").alias("pattern")) for k, r in enumerate(rules)])
    inner = F.trim(F.regexp_replace(lower_ascii(F.coalesce("text", F.lit(""))), _SEPARATORS, " "))
    norm = docs.select(F.col("doc_id"), F.concat(F.lit(" "), inner, F.lit(" ")).alias("norm"))
    words = F.array_distinct(F.regexp_extract_all("norm", F.lit(f"(?<= )(?:{gates})(?= )"), F.lit(0)))
    gated = norm.withColumn("gates", F.array_distinct(F.flatten(F.transform(words, lambda w: gates_of[w]))))
    tried = F.when(F.size("gates") > 0, F.filter(table, lambda r: F.array_contains("gates", r["gate"])
                                                 & F.contains("norm", r["keyword"])))
    # one pass per rule marks its matches; every second part is one
    parts = F.transform(F.col("tried"), lambda r: F.struct(
        r["rule"].alias("rule"), F.split(F.regexp_replace("norm", r["pattern"], F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1).alias("parts")))
    places = F.transform(F.filter(parts, lambda x: F.size(x["parts"]) > 1), lambda x: F.struct(
        x["rule"].alias("rule"),
        F.transform(F.filter(x["parts"], lambda _, i: i % 2 == 0), lambda y: (_n_words(y) - 1).cast("int")).alias("between"),
        F.transform(F.filter(x["parts"], lambda _, i: i % 2 == 1), lambda y: (_n_words(y) + 1).cast("int")).alias("long")))
    scanned = staged(gated.withColumn("tried", tried).select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.when(F.trim("norm") == "", 0).otherwise(_n_words(F.col("norm")) - 1).cast("long").alias("n_words"),
        places.alias("places")), "licenses")
    found = scanned.select("row", F.explode("places").alias("place"))
    found = (found.select("row", "place.rule", F.posexplode(F.arrays_zip("place.between", "place.long")).alias("nth", "m"))
             .where("m.long is not null")
             .withColumn("before", F.sum(F.col("m.between") + F.col("m.long")).over(
                 Window.partitionBy("row", "rule").orderBy("nth")))
             .select("row", "rule", (F.col("before") - F.col("m.long")).alias("first"), (F.col("before") - 1).alias("last")))
    about = F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"),
                               F.lit(r.confidence).alias("confidence"), F.lit(r.base).alias("base")) for r in rules])
    found = found.withColumn("about", F.get(about, F.col("rule"))).select("row", "rule", "first", "last", "about.*")
    earlier = (Window.partitionBy("row").orderBy("first", F.col("last").desc(), F.col("priority").desc(), "rule")
               .rowsBetween(Window.unboundedPreceding, -1))
    # of all that start no later, the furthest end at this priority or above
    levels = sorted({r.priority for r in rules})
    reach = F.coalesce(*[F.when(F.col("priority") == level, F.coalesce(
        F.max(F.when(F.col("priority") >= level, F.col("last"))).over(earlier), F.lit(-1))) for level in levels])
    kept = found.withColumn("reach", reach).where(F.col("base") | (F.col("reach") < F.col("last")))
    sorted_labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    base = F.col("base")
    summed = kept.groupBy("row").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        sorted_labels(F.when(base, F.col("label"))).alias("base_labels"), sorted_labels("label").alias("labels"),
        F.max("confidence").alias("score"), F.count("*").alias("n_detections"))
    none = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0, "n_detections": 0}
    return (scanned.select("row", "doc_id", "n_words").join(summed, "row", "left").na.fill(none)
            .select("doc_id", "n_words", "n_base", F.col("first_word").cast("long"), F.col("last_word").cast("long"),
                    "base_labels", "labels", "score", "n_detections"))
