"""License scans by ordered signature rules. DataFrame functions only.

A text's ASCII capitals are lowered and its words (runs of ASCII letters and digits and other characters beyond ASCII)
are written with their numbers, ' mit#0  license#1 ', so a rule is a regular expression over words and a match tells its
place by itself. Rules are tried only on texts with any gate substring, and each only where its own keyword occurs.
Detections are ordered by start, longest first, then by priority; one that lies inside an earlier one of the same or a
higher priority is suppressed. All of this happens within the row, in time linear in its matches: nothing is shuffled.

Base places (BASE phrases, every place, never suppressed) are counted beside the rules; their labels always stay.
`score` is the highest confidence among base labels and detections that stay, 0 without any.

Cases: a null text counts as empty; texts without a detection have no labels (empty strings), nulls for the first and
last word and score 0. Rows that repeat an id are scanned each. An empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD, NOT_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before capitals are lowered.
CASED_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Phrase and label of the base places.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Detections that are gathered in one list.
TOGETHER = 128
#: Confidence of the priorities 1, 2 and 3, and of a base place.
CONFIDENCE, BASE_CONFIDENCE = (0.95, 0.8, 0.4), 0.6


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    priority: int
    pattern: str


def over_words(signature: str) -> str:
    """A signature's words as a pattern: a|b is either, x? may be missing, * stands for up to three words."""
    out = []
    for w in signature.split():
        if w == "*":
            out.append("(?: [^ ]+ ){0,3}")
        elif w.endswith("?"):
            out.append(f"(?: (?:{w[:-1]})#[0-9]+ )?")
        else:
            out.append(f" (?:{w})#[0-9]+ " if "|" in w else f" {w}#[0-9]+ ")
    return "".join(out)


# Hand-written signatures: label, the words that gate it (each name has exactly one of them), the licence's names, its SPDX identifier in words.
FAMILIES = (
    ("mit", "mit|expat", ("mit license|licence", "expat license|licence"), "mit"),
    ("mit-0", "attribution", ("mit no attribution license?",), "mit 0"),
    ("apache-2.0", "apache", ("apache software? license|licence version|v? 2|v2 0?", "apache 2|v2 0? license|licence?"), "apache 2 0"),
    ("apache-1.1", "apache", ("apache software? license|licence version|v? 1|v1 1",), "apache 1 1"),
    ("gpl-1.0", "public", ("gnu? general public license|licence version|v? 1|v1",), "gpl 1 0"),
    ("gpl-2.0", "public", ("gnu? general public license|licence version|v? 2|v2",), "gpl 2 0"),
    ("gpl-3.0", "public", ("gnu? general public license|licence version|v? 3|v3",), "gpl 3 0"),
    ("gpl-2.0-short", "gpl|gplv2", ("gnu? gpl version|v? 2|v2", "gnu? gplv2"), "gpl 2 0 only"),
    ("gpl-3.0-short", "gpl|gplv3", ("gnu? gpl version|v? 3|v3", "gnu? gplv3"), "gpl 3 0 only"),
    ("gpl-2.0-or-later", "later", ("general public license * version|v? 2|v2 or * any? later version?",), "gpl 2 0 or later"),
    ("gpl-3.0-or-later", "later", ("general public license * version|v? 3|v3 or * any? later version?",), "gpl 3 0 or later"),
    ("lgpl-2.0", "lesser|library", ("gnu? library general public license|licence version|v? 2|v2?",), "lgpl 2 0"),
    ("lgpl-2.1", "lesser", ("gnu? lesser general public license|licence version|v? 2|v2 1",), "lgpl 2 1"),
    ("lgpl-3.0", "lesser", ("gnu? lesser general public license|licence version|v? 3|v3",), "lgpl 3 0"),
    ("agpl-3.0", "affero", ("gnu? affero general public license|licence version|v? 3|v3?",), "agpl 3 0"),
    ("gfdl-1.3", "documentation", ("gnu? free documentation license|licence version|v? 1|v1? 3?",), "gfdl 1 3"),
    ("bsd-2-clause", "bsd|freebsd", ("bsd 2 clause license?", "simplified bsd license|licence", "freebsd license|licence"), "bsd 2 clause"),
    ("bsd-3-clause", "bsd", ("bsd 3 clause license?", "new|modified|revised bsd license|licence"), "bsd 3 clause"),
    ("bsd-4-clause", "bsd", ("bsd 4 clause license?", "original bsd license|licence"), "bsd 4 clause"),
    ("bsd-0-clause", "bsd|0bsd", ("bsd zero clause license?", "0bsd"), "0bsd"),
    ("bsd", "bsd", ("bsd license|licence", "bsd style license|licence"), "bsd"),
    ("isc", "isc", ("isc license|licence",), "isc"),
    ("mpl-1.1", "mozilla", ("mozilla public license|licence version|v? 1|v1 1",), "mpl 1 1"),
    ("mpl-2.0", "mozilla", ("mozilla public license|licence version|v? 2|v2 0?",), "mpl 2 0"),
    ("epl-1.0", "eclipse", ("eclipse public license|licence version|v? 1|v1 0?",), "epl 1 0"),
    ("epl-2.0", "eclipse", ("eclipse public license|licence version|v? 2|v2 0?",), "epl 2 0"),
    ("edl-1.0", "eclipse", ("eclipse distribution license|licence version|v? 1|v1? 0?",), "edl 1 0"),
    ("cddl-1.0", "cddl|common", ("common development and distribution license|licence version|v? 1|v1? 0?",), "cddl 1 0"),
    ("cpl-1.0", "common", ("common public license|licence version|v? 1|v1? 0?",), "cpl 1 0"),
    ("cc0-1.0", "cc0|creative", ("cc0 1 0? universal?", "creative commons zero"), "cc0 1 0"),
    ("cc-by-3.0", "creative|cc", ("creative commons attribution 3 0", "cc by 3 0"), "cc by 3 0"),
    ("cc-by-4.0", "creative|cc", ("creative commons attribution 4 0", "cc by 4 0"), "cc by 4 0"),
    ("cc-by-sa-3.0", "creative|cc", ("creative commons attribution share alike|sharealike 3 0", "cc by sa 3 0"), "cc by sa 3 0"),
    ("cc-by-sa-4.0", "creative|cc", ("creative commons attribution share alike|sharealike 4 0", "cc by sa 4 0"), "cc by sa 4 0"),
    ("cc-by-nc-3.0", "creative|cc", ("creative commons attribution non? noncommercial|commercial 3 0", "cc by nc 3 0"), "cc by nc 3 0"),
    ("cc-by-nc-4.0", "creative|cc", ("creative commons attribution non? noncommercial|commercial 4 0", "cc by nc 4 0"), "cc by nc 4 0"),
    ("cc-by-nd-4.0", "creative|cc", ("creative commons attribution no? derivatives|noderivatives 4 0", "cc by nd 4 0"), "cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "creative|cc", ("creative commons attribution * share alike|sharealike 4 0", "cc by nc sa 4 0"), "cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "creative|cc", ("creative commons attribution * derivatives|noderivatives 4 0", "cc by nc nd 4 0"), "cc by nc nd 4 0"),
    ("unlicense", "unlicense|released", ("the? unlicense", "free and unencumbered software released into the public domain"), "unlicense"),
    ("wtfpl", "wtfpl|what", ("wtfpl", "do what the * you want to public license|licence"), "wtfpl"),
    ("zlib", "zlib", ("zlib license|licence", "zlib libpng license|licence"), "zlib"),
    ("bsl-1.0", "boost", ("boost software license|licence version|v? 1|v1? 0?",), "bsl 1 0"),
    ("artistic-2.0", "artistic", ("artistic license|licence version|v? 2|v2? 0?",), "artistic 2 0"),
    ("psf-2.0", "python|psf", ("python software foundation license|licence", "psf license|licence"), "psf 2 0"),
    ("openssl", "openssl", ("openssl license|licence",), "openssl"),
    ("ofl-1.1", "font", ("sil? open font license|licence version|v? 1|v1? 1?",), "ofl 1 1"),
    ("sspl-1.0", "server", ("server side public license|licence version|v? 1|v1?",), "sspl 1 0"),
    ("elastic-2.0", "elastic", ("elastic license|licence version|v? 2|v2? 0?",), "elastic 2 0"),
    ("busl-1.1", "business", ("business source license|licence version|v? 1|v1? 1?",), "busl 1 1"),
    ("eupl-1.2", "european", ("european union public license|licence version|v? 1|v1? 2?",), "eupl 1 2"),
    ("postgresql", "postgresql", ("postgresql license|licence",), "postgresql"),
    ("ms-pl", "microsoft", ("microsoft public license|licence",), "ms pl"),
    ("ms-rl", "microsoft", ("microsoft reciprocal license|licence",), "ms rl"),
    ("x11", "x11", ("x11 license|licence", "mit x11 license|licence"), "x11"),
    ("ncsa", "illinois", ("university of illinois ncsa open source license|licence",), "ncsa"),
    ("vim", "vim", ("vim license|licence",), "vim"),
    ("ruby", "ruby", ("ruby license|licence",), "ruby"),
    ("php-3.01", "php", ("php license|licence version|v? 3|v3? 0?",), "php 3 01"),
    ("afl-3.0", "academic", ("academic free license|licence version|v? 3|v3? 0?",), "afl 3 0"),
    ("osl-3.0", "open", ("open software license|licence version|v? 3|v3? 0?",), "osl 3 0"),
    ("odbl-1.0", "database", ("open database license|licence version|v? 1|v1? 0?",), "odbl 1 0"),
    ("upl-1.0", "universal", ("universal permissive license|licence version|v? 1|v1? 0?",), "upl 1 0"),
    ("proprietary", "rights", ("all rights reserved",), "proprietary"),
)
#: Substrings of which every signature needs one; texts without any are not scanned.
GATE = ("licen", "gpl", "apache", "creative", "cc", "wtfpl", "bsd", "clause", "unencumbered", "attribution", "rights", "hereby", "distribut", "endorse", "acknowledgement", "copyleft",
        "foundation", "warrant", "domain", "proprietary", "reproduction", "copyright", "furnished", "mozilla", "eclipse", "misrepresent", "openssl", "reserved")

# Hand-written clauses that name no licence.
CLAUSES = (
    ("mit", "hereby", 2, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission", 2, "permission to use copy modify and|or or? distribute this software for any purpose"),
    ("bsd", "redistribution", 2, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", 2, "neither the name of * nor the names of its contributors may be used to endorse or promote"),
    ("bsd-4-clause", "acknowledgement", 2, "must display the following acknowledgement"),
    ("gpl", "copyleft", 3, "copyleft license|licence?"),
    ("gpl", "foundation", 2, "as published by the free software foundation"),
    ("warranty-disclaimer", "warranty", 3, "without any warranty"),
    ("warranty-disclaimer", "warranties", 3, "without any warranties"),
    ("warranty-disclaimer", "warranty", 3, "as is without warranty of any kind"),
    ("public-domain", "domain", 3, "in|into the public domain"),
    ("proprietary", "proprietary", 3, "proprietary and confidential"),
    ("proprietary", "reproduction", 3, "unauthorized reproduction or distribution"),
    ("cc", "creative", 3, "creative commons license|licence?"),
    ("copyright", "copyright", 3, "copyright c? 19[0-9][0-9]|20[0-9][0-9]"),
    ("license-notice", "licensed", 3, "licensed under the? terms? of? the?"),
)


#: Hand-written sentences and turns of phrase by which licences and notices are told: label, priority, words.
SENTENCES = (
    ("mit", 2, "deal in the software without restriction including without limitation the rights to use"),
    ("mit", 2, "the above copyright notice and this permission notice shall be included in all copies"),
    ("mit", 2, "permit persons to whom the software is furnished to do so"),
    ("mit", 3, "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit", 3, "this project is licensed under mit"),
    ("mit", 3, "mit licensed"),
    ("mit", 3, "the mit licence|license mit"),
    ("mit-0", 2, "permission is hereby granted * to deal in the software without restriction * without any conditions"),
    ("apache-2.0", 2, "you may not use this file except in compliance with the license"),
    ("apache-2.0", 2, "you may obtain a copy of the license at"),
    ("apache-2.0", 2, "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", 3, "distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2.0", 3, "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("apache-2.0", 2, "apache org licenses license 2 0"),
    ("apache-2.0", 2, "asl 2 0 license|licence"),
    ("apache-2.0", 3, "grant of patent license subject to the terms and conditions of this license"),
    ("apache-1.1", 2, "this product includes software developed by the apache software foundation"),
    ("apache-1.1", 3, "products derived from this software may not be called apache"),
    ("gpl", 2, "this program is free software you can redistribute it and|or or? modify it under the terms"),
    ("gpl", 2, "this is free software see the source for copying conditions there is no warranty"),
    ("gpl", 3, "distributed in the hope that it will be useful but without any warranty"),
    ("gpl", 3, "merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl", 2, "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", 2, "see the gnu general public license for more details"),
    ("gpl", 3, "gnu org licenses gpl"),
    ("gpl", 3, "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl", 3, "released under the gnu gpl"),
    ("gpl", 3, "gpl licensed"),
    ("gpl", 3, "gpl compatible"),
    ("gpl-2.0", 2, "either version 2 of the license or at your option any later version"),
    ("gpl-2.0", 2, "version 2 june 1991 copyright"),
    ("gpl-2.0", 2, "gnu org licenses old licenses gpl 2 0"),
    ("gpl-2.0", 2, "under the terms of version 2 of the gnu general public license"),
    ("gpl-3.0", 2, "either version 3 of the license or at your option any later version"),
    ("gpl-3.0", 2, "version 3 29 june 2007 copyright"),
    ("gpl-3.0", 2, "gnu org licenses gpl 3 0"),
    ("gpl-3.0", 2, "under the terms of version 3 of the gnu general public license"),
    ("gpl-2.0-classpath-exception", 2, "gpl * with the? classpath exception"),
    ("gpl-3.0-linking-exception", 3, "as a special exception the copyright holders of this library give you permission to link"),
    ("lgpl", 2, "you should have received a copy of the gnu lesser general public license along with this"),
    ("lgpl", 2, "you should have received a copy of the gnu library general public license along with this"),
    ("lgpl", 2, "this library is free software you can redistribute it and|or or? modify it under the terms of the gnu lesser general public license"),
    ("lgpl", 3, "lgpl licensed"),
    ("lgpl", 3, "gnu org licenses lgpl"),
    ("lgpl-2.1", 2, "version 2 1 february 1999 copyright"),
    ("lgpl-2.1", 2, "either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0", 2, "incorporates the terms and conditions of version 3 of the gnu general public license supplemented"),
    ("agpl", 2, "you should have received a copy of the gnu affero general public license along with this program"),
    ("agpl", 3, "agpl licensed|license|licence"),
    ("agpl-3.0", 2, "version 3 19 november 2007 copyright"),
    ("agpl-3.0", 2, "remote network interaction use with the gnu general public license"),
    ("gfdl", 2, "permission is granted to copy distribute and|or or? modify this document under the terms of the gnu free documentation license"),
    ("gfdl", 3, "with no invariant sections no front cover texts and no back cover texts * license"),
    ("gfdl-1.2", 2, "gnu free documentation license version 1 2"),
    ("bsd", 2, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 2, "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 3, "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("bsd", 3, "bsd licensed"),
    ("bsd-3-clause", 2, "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause", 2, "the names of its contributors may not be used to endorse or promote"),
    ("bsd-4-clause", 2, "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-4-clause-uc", 2, "this product includes software developed by the university of california berkeley and its contributors * copyright"),
    ("bsd-2-clause-patent", 2, "bsd 2 clause plus patent license"),
    ("bsd-3-clause-clear", 2, "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-3-clause-lbnl", 2, "lawrence berkeley national labs? bsd variant license"),
    ("bsd-0-clause", 2, "permission to use copy modify and|or or? distribute this software for any purpose with or without fee is hereby granted the author disclaims"),
    ("isc", 2, "provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", 3, "the author disclaims all warranties with regard to this software"),
    ("mpl", 2, "this source code form is subject to the terms of the mozilla public license"),
    ("mpl-2.0", 2, "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", 2, "mozilla org mpl 2 0"),
    ("mpl-2.0", 3, "incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl-1.1", 2, "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", 2, "mozilla public license version 1 0"),
    ("npl-1.1", 2, "netscape public license version 1 1"),
    ("epl", 2, "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", 3, "eclipse org legal epl"),
    ("epl-2.0", 2, "secondary licenses when the following conditions * eclipse public license"),
    ("cpl-1.0", 3, "accompanying program is provided under the terms of this common public license"),
    ("cddl-1.0", 2, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1.1", 2, "common development and distribution license version 1 1"),
    ("ipl-1.0", 2, "ibm public license version 1 0"),
    ("cc", 2, "this work is licensed under a creative commons"),
    ("cc", 2, "to view a copy of this license visit * creativecommons org"),
    ("cc", 3, "creativecommons org licenses"),
    ("cc", 3, "some rights reserved"),
    ("cc-by", 2, "creative commons attribution license|licence"),
    ("cc-by-sa", 2, "creative commons attribution share alike|sharealike license|licence"),
    ("cc-by-nc", 2, "creative commons attribution non? noncommercial|commercial license|licence"),
    ("cc-by-nd", 2, "creative commons attribution no? derivatives|noderivatives license|licence"),
    ("cc-by-1.0", 2, "creative commons attribution 1 0"),
    ("cc-by-2.0", 2, "creative commons attribution 2 0"),
    ("cc-by-2.5", 2, "creative commons attribution 2 5"),
    ("cc-by-sa-2.0", 2, "creative commons attribution share alike|sharealike 2 0"),
    ("cc-by-sa-2.5", 2, "creative commons attribution share alike|sharealike 2 5"),
    ("cc-by-nc-sa-3.0", 2, "cc by nc sa 3 0"),
    ("cc-by-nc-nd-3.0", 2, "cc by nc nd 3 0"),
    ("cc-by-nd-3.0", 2, "cc by nd 3 0"),
    ("cc0-1.0", 2, "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", 2, "cc0 1 0 universal public domain dedication"),
    ("cc0-1.0", 3, "no rights reserved"),
    ("cc-pdm-1.0", 2, "public domain mark 1 0"),
    ("public-domain", 3, "this work is in the public domain"),
    ("public-domain", 3, "dedicated to the public domain"),
    ("public-domain", 3, "placed in the public domain"),
    ("public-domain", 3, "the author disclaims copyright to this source code"),
    ("public-domain", 3, "public domain dedication"),
    ("unlicense", 2, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", 2, "unlicense org"),
    ("zlib", 2, "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 2, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", 3, "this notice may not be removed or altered from any source distribution"),
    ("libpng", 2, "libpng license|licence"),
    ("bsl-1.0", 2, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("bsl-1.0", 2, "distributed under the boost software license"),
    ("artistic-1.0", 2, "artistic license|licence version|v? 1|v1 0?"),
    ("artistic", 3, "the artistic license|licence"),
    ("perl", 2, "you can redistribute it and|or or? modify it under the same terms as perl itself"),
    ("python-2.0", 2, "python license|licence version|v? 2"),
    ("psf-2.0", 2, "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("openssl", 2, "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ofl-1.1", 2, "this font software is licensed under the sil open font license"),
    ("ofl-1.1", 3, "reserved font name"),
    ("sspl-1.0", 3, "sspl license|licence"),
    ("busl-1.1", 2, "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("busl-1.1", 3, "additional use grant * license|licensed|licensor"),
    ("commons-clause", 2, "commons clause license condition"),
    ("commons-clause", 2, "the license does not include and the license does not grant to you the right to sell the software"),
    ("polyform-noncommercial-1.0.0", 2, "polyform noncommercial license 1 0 0"),
    ("polyform-strict-1.0.0", 2, "polyform strict license 1 0 0"),
    ("polyform-shield-1.0.0", 2, "polyform shield license 1 0 0"),
    ("parity-7.0.0", 2, "the parity public license 7 0 0"),
    ("blueoak-1.0.0", 2, "blue oak model license 1 0 0"),
    ("hippocratic-2.1", 2, "hippocratic license version? 2 1"),
    ("json", 2, "the json license|licence"),
    ("beerware", 2, "the beer ware license|licence"),
    ("curl", 2, "curl license|licence"),
    ("w3c", 2, "w3c software notice and license"),
    ("w3c", 2, "w3c document license|licence"),
    ("unicode", 2, "unicode license agreement data files and software"),
    ("icu", 2, "icu license|licence"),
    ("ftl", 2, "freetype project license|licence"),
    ("imagemagick", 2, "imagemagick license|licence"),
    ("sleepycat", 2, "sleepycat license|licence"),
    ("sqlite", 3, "sqlite is in the public domain"),
    ("tcl", 2, "tcl tk license|licence"),
    ("latex-lppl-1.3c", 2, "latex project public license"),
    ("qpl-1.0", 2, "q public license version 1 0"),
    ("zpl-2.1", 2, "zope public license version? 2 1"),
    ("cecill-2.1", 2, "cecill free software license agreement"),
    ("cecill-b", 2, "cecill b license|licence"),
    ("cecill-c", 2, "cecill c license|licence"),
    ("mulanpsl-2.0", 2, "mulan permissive software license"),
    ("ecl-2.0", 2, "educational community license version 2 0"),
    ("apsl-2.0", 2, "apple public source license version 2 0"),
    ("intel", 2, "intel open source license"),
    ("nokia", 2, "nokia open source license"),
    ("cpal-1.0", 2, "common public attribution license version 1 0"),
    ("rpl-1.5", 2, "reciprocal public license version? 1 5"),
    ("simpl-2.0", 2, "simple public license version? 2 0"),
    ("ncsa", 2, "permission is hereby granted * to deal with the software without restriction"),
    ("postgresql", 2, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ntp", 2, "ntp license|licence"),
    ("xfree86-1.1", 2, "xfree86 license|licence"),
    ("odc-by-1.0", 2, "open data commons attribution license"),
    ("pddl-1.0", 2, "open data commons public domain dedication and license"),
    ("odbl-1.0", 2, "open data commons open database license"),
    ("cdla-permissive-2.0", 2, "community data license agreement permissive"),
    ("cdla-sharing-1.0", 2, "community data license agreement sharing"),
    ("ogl-uk-3.0", 2, "open government licence|license v3 0"),
    ("ogl-uk", 3, "open government licence|license"),
    ("etalab-2.0", 2, "licence|license ouverte open licence|license"),
    ("openrail", 2, "openrail m license|licence"),
    ("openrail", 2, "responsible ai license|licence|licenses"),
    ("llama", 2, "llama community license agreement"),
    ("proprietary", 3, "this software is proprietary"),
    ("proprietary", 3, "end user license agreement"),
    ("proprietary", 3, "you may not copy modify or distribute this"),
    ("proprietary", 3, "no part of this publication may be reproduced stored * reproduction|copyright|distributed"),
    ("proprietary", 3, "may not be reproduced or distributed without * permission|consent"),
    ("proprietary", 3, "for internal use only * distribution|distribute|proprietary"),
    ("proprietary", 3, "confidential and proprietary information"),
    ("proprietary", 3, "trade secret * proprietary"),
    ("freeware", 3, "freeware license|licence"),
    ("shareware", 3, "shareware license|licence"),
    ("commercial", 3, "commercial license|licence"),
    ("commercial", 3, "a commercial licence|license is required"),
    ("non-commercial", 3, "for non commercial use only * license|licensed|distribution|rights"),
    ("dual-license", 3, "dual licensed under"),
    ("dual-license", 3, "at your option licensed|license under either"),
    ("license-notice", 3, "see the? license|licence file|txt|md"),
    ("license-notice", 3, "see copying for license|licence details"),
    ("license-notice", 3, "this file is part of * distributed|licensed|license|copyright"),
    ("license-notice", 3, "the full text of the license|licence"),
    ("license-notice", 3, "use of this source code is governed by a * license|licence"),
    ("license-notice", 3, "by using this software you agree to the terms of this license|licence"),
    ("license-notice", 3, "all files in this directory are licensed|distributed"),
    ("warranty-disclaimer", 3, "no warranty is given|expressed|implied"),
    ("warranty-disclaimer", 3, "warranties of merchantability and? fitness for a particular purpose"),
    ("warranty-disclaimer", 3, "implied warranties of merchantability"),
    ("copyright", 3, "copyright reserved"),
    ("copyright", 3, "copyright holders?"),
    ("copyright", 3, "c copyright by"),
)


def required(signature: str) -> str:
    """The longest word that the signature cannot do without: its keyword."""
    plain = [w for w in signature.split() if w != "*" and not w.endswith("?") and "|" not in w and w.isalnum()]
    return max(plain, key=len)


def rules() -> list[Rule]:
    """In order: the place in this list breaks ties between detections of one priority over the same words."""
    out = []
    for label, keywords, names, spdx in FAMILIES:
        label = label.removesuffix("-short")
        for keyword in keywords.split("|"):
            for name in names:
                if keyword not in name.split():
                    continue
                out += [
                    Rule(label, keyword, 1, over_words(f"licensed|released|distributed|available|provided|published under the? terms? and? conditions? of? the? {name}")),
                    Rule(label, keyword, 1, over_words(f"subject to the? terms? of? the? {name}")),
                    Rule(label, keyword, 2, over_words(name)),
                ]
        for tag in ("spdx license identifier", "license expression"):
            out.append(Rule(label, tag.split()[0], 1, over_words(f"{tag} {spdx}")))
    out += [Rule(label, keyword, p, over_words(s)) for label, keyword, p, s in CLAUSES]
    return out + [Rule(label, required(s), p, over_words(s)) for label, p, s in SENTENCES]


def gated(signature: str) -> bool:
    """Whether some word that the signature cannot do without holds a gate substring, whichever way it is met."""
    needed = [w.split("|") for w in signature.split() if w != "*" and not w.endswith("?")]
    return any(all(any(g in x for g in GATE) for x in ways) for ways in needed)


for _label, _keywords, _names, _ in FAMILIES:
    if any(sum(k in n.split() for k in _keywords.split("|")) != 1 for n in _names):
        raise ValueError(f"a name of {_label} has not exactly one keyword, a word that it cannot do without")
if not all(c[1] in c[3].split() for c in CLAUSES):
    raise ValueError("a clause can do without its keyword")
if not all(gated(n) for f in FAMILIES for n in f[2]) or not all(gated(c[3]) for c in CLAUSES) or not all(gated(p) for p, _ in BASE) or not all(gated(x[2]) for x in SENTENCES):
    raise ValueError("a signature has no gate: " + "; ".join(x[2] for x in SENTENCES if not gated(x[2])))


def gate(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for g in GATE:
        out = out | F.contains(low, F.lit(g))
    return out


def words_numbered(text: Column) -> Column:
    """' w0#0  w1#1 ' of a text; two spaces of a text without words."""
    words = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({CASED_WORD})"), F.lit(1))
    return F.concat(F.lit(" "), F.array_join(F.transform(words, lambda w, i: F.concat(w, F.lit("#"), i.cast("string"))), "  "), F.lit(" "))


def places(numbered: Column, pattern: Column) -> Column:
    """Starts and ends (in words, end exclusive) of a pattern's matches, in order."""
    found = F.call_function("regexp_extract_all", numbered, pattern, F.lit(0))
    first = lambda m: F.substring_index(F.substring_index(m, "#", 2), " ", 2)  # noqa: E731  " word#12 " to " word#12"
    number = lambda x: F.substring_index(x, "#", -1).cast("int")
    return F.transform(found, lambda m: F.struct(number(first(m)).alias("s"), (F.trim(F.substring_index(m, "#", -1)).cast("int") + 1).alias("e")))


def base_places(spaced: Column, phrase: str) -> Column:
    return places(spaced, F.lit(over_words(phrase)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels, labels, score; and detections, those that stay."""
    all_rules = rules()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.select("id", F.regexp_count("text", F.lit(CASED_WORD)).cast("long").alias("n_words"), F.when(gate(F.col("text")), words_numbered(F.col("text"))).alias("spaced"))
    for k, (phrase, _) in enumerate(BASE):
        rows = rows.withColumn(f"b{k}", base_places(F.col("spaced"), phrase))
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r.keyword).alias("k"), F.lit(r.priority).alias("p"), F.lit(r.label).alias("l"), F.lit(r.pattern).alias("x")) for i, r in enumerate(all_rules)])
    tried = F.filter(table, lambda r: F.contains(F.col("spaced"), F.concat(F.lit(" "), r["k"], F.lit("#"))))

    def hits(r):
        return F.transform(places(F.col("spaced"), r["x"]), lambda d: F.struct(d["s"].alias("s"), (-d["e"]).alias("neg_end"), r["p"].alias("p"), r["i"].alias("i"), r["l"].alias("l")))

    rows = rows.withColumn("found", F.array_sort(F.flatten(F.transform(tried, hits))))
    ends = F.array(F.lit(-1), F.lit(-1), F.lit(-1))
    empty = F.array().cast("array<struct<s:int,neg_end:int,p:int,i:int,l:string>>")

    full = lambda acc: F.size(acc["now"]) >= TOGETHER

    def keep(acc, d):
        """m: the farthest end so far by priority; what stays is gathered in short lists, so that none is copied often."""
        e = -d["neg_end"]
        inside = F.element_at(acc["m"], d["p"]) >= e
        now = F.when(full(acc), F.array(d)).otherwise(F.concat(acc["now"], F.array(d)))
        return F.struct(
            F.transform(acc["m"], lambda m, j: F.when(j + 1 >= d["p"], F.greatest(m, e)).otherwise(m)).alias("m"),
            F.when(inside, acc["now"]).otherwise(now).alias("now"),
            F.when(inside | ~full(acc), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))).alias("done"))

    start = F.struct(ends.alias("m"), empty.alias("now"), F.array().cast("array<array<struct<s:int,neg_end:int,p:int,i:int,l:string>>>").alias("done"))
    stay = F.aggregate("found", start, keep, lambda acc: F.concat(F.flatten(acc["done"]), acc["now"]))
    rows = rows.withColumn("detections", F.coalesce(stay, empty))
    b = F.flatten(F.array(*[F.coalesce(F.col(f"b{k}"), F.array().cast("array<struct<s:int,e:int>>")) for k in range(len(BASE))]))
    own = F.filter(F.array(*[F.when(F.size(F.col(f"b{k}")) > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]), lambda x: x.isNotNull())
    rows = rows.withColumn("base", F.transform(b, lambda x: x["s"])).withColumn("own", own)
    confidence = F.transform("detections", lambda d: F.element_at(F.array(*map(F.lit, CONFIDENCE)), d["p"]))
    best = F.greatest(F.coalesce(F.array_max(confidence), F.lit(0.0)), F.when(F.size("base") > 0, F.lit(BASE_CONFIDENCE)).otherwise(F.lit(0.0)))
    return rows.select(
        F.col("id").alias(id_col), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base").cast("long").alias("first_word"),
        F.array_max("base").cast("long").alias("last_word"), F.array_join(F.array_sort("own"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("own", F.transform("detections", lambda d: d["l"])))), ",").alias("labels"),
        best.alias("score"), "detections")


def sql() -> str:
    """The same for DuckDB, with windows in place of folds."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    plain = lambda pattern: pattern.replace("#[0-9]+", "")  # noqa: E731  here words have no numbers: places are counted from gaps
    values = ",\n    ".join(f"({i}, {quoted(r.keyword)}, {r.priority}, {quoted(r.label)}, {quoted(plain(r.pattern))})" for i, r in enumerate(rules()))
    base = ",\n    ".join(f"({quoted(plain(over_words(p)))}, {quoted(label)})" for p, label in BASE)
    spaces = "len({0}) - len(replace({0}, ' ', ''))"
    where = f"""list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: {spaces.format('x')})) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: {spaces.format('x')})), 0))"""
    confidence = " ".join(f"WHEN {k} THEN {c}::DOUBLE" for k, c in enumerate(CONFIDENCE, 1))
    return rf"""
WITH t AS (
  SELECT doc_id, ' ' || trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NOT_WORD}', '  ', 'g')) || ' ' AS w,
         len(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}'))::BIGINT AS n_words
  FROM documents
), base_rules(x, l) AS (VALUES
    {base}
), b0 AS (
  SELECT doc_id, l, regexp_extract_all(w, x) AS m, string_split_regex(w, x) AS g FROM t, base_rules WHERE regexp_matches(w, x)
), b AS (
  SELECT doc_id, l, unnest({where}) // 2 AS s FROM b0
), base AS (
  SELECT doc_id, count(*) AS n_base, min(s)::BIGINT AS first_word, max(s)::BIGINT AS last_word, list(DISTINCT l) AS ls FROM b GROUP BY doc_id
), rules(i, k, p, l, x) AS (VALUES
    {values}
), r0 AS (
  SELECT doc_id, i, p, l, regexp_extract_all(w, x) AS m, string_split_regex(w, x) AS g
  FROM t JOIN rules ON contains(w, ' ' || k || ' ') WHERE regexp_matches(w, x)
), r1 AS (
  SELECT doc_id, i, p, l, unnest({where}) // 2 AS s, unnest(list_transform(m, lambda x: ({spaces.format('x')}) // 2)) AS n FROM r0
), r2 AS (
  SELECT doc_id, i, p, l, s + n AS e,
         max(s + n) FILTER (p <= 1) OVER q AS m1, max(s + n) FILTER (p <= 2) OVER q AS m2, max(s + n) FILTER (p <= 3) OVER q AS m3
  FROM r1 WINDOW q AS (PARTITION BY doc_id ORDER BY s, s + n DESC, p, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), r AS (
  SELECT doc_id, list(DISTINCT l) AS ls, max(CASE p {confidence} END) AS c FROM r2
  WHERE coalesce(CASE p WHEN 1 THEN m1 WHEN 2 THEN m2 ELSE m3 END, -1) < e GROUP BY doc_id
)
SELECT t.doc_id, n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(r.ls, [])))), ','), '') AS labels,
       greatest(coalesce(r.c, 0), CASE WHEN n_base > 0 THEN {BASE_CONFIDENCE}::DOUBLE ELSE 0 END)::DOUBLE AS score
FROM t LEFT JOIN base ON t.doc_id = base.doc_id LEFT JOIN r ON t.doc_id = r.doc_id
"""
