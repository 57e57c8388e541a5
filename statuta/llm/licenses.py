"""License scans by ordered signature rules. DataFrame operations only.

A text is lower-cased (A-Z), its words are set apart by two blanks, and every rule is a regular
expression over that form. A keyword gates each rule; matches get character intervals; a match is
suppressed if a better rule's match contains it (lower priority number, or the same number and a
longer match, or the same interval and a smaller rule id). The surviving labels are the document's.

Texts are read once: matches become numbers in the row that holds the text, and only numbers go on.

Nulls: a null text is empty; a null doc_id is kept. Ties: matches of one interval and priority go to
the smaller rule. A text of any length is scanned whole. Empty tables give empty results. Repeated
rows are scanned alike and all returned. Columns other than doc_id and text are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases with their labels that every result counts.
BASE_PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: label, keyword that must occur (for names without it see gate_word), ways to name the license (words; [x] optional, a|b either).
FAMILIES = [
    ("mit", "mit", ["mit", "expat"]),
    ("mit-0", "mit", ["mit 0", "mit no attribution"]),
    ("x11", "x11", ["x11"]),
    ("apache-1", "apache", ["apache [software] [license] [version|v] 1 0|1", "apache 1 0|1"]),
    ("apache-2", "apache", ["apache [software] [license] [version|v] 2 [0]", "apache 2 0", "asl 2 0"]),
    ("bsd-2-clause", "bsd", ["bsd 2 clause", "simplified bsd", "freebsd", "two clause bsd"]),
    ("bsd-3-clause", "bsd", ["bsd 3 clause", "new bsd", "revised bsd", "modified bsd", "three clause bsd"]),
    ("bsd-4-clause", "bsd", ["bsd 4 clause", "original bsd", "four clause bsd"]),
    ("0bsd", "bsd", ["0bsd", "zero clause bsd"]),
    ("bsd", "bsd", ["bsd", "bsd style"]),
    ("gpl-1", "gpl", ["gpl [version|v] 1 [0]", "gplv1"]),
    ("gpl-2", "gpl", ["gpl [version|v] 2 [0]", "gplv2"]),
    ("gpl-3", "gpl", ["gpl [version|v] 3 [0]", "gplv3"]),
    ("gpl", "gpl", ["gpl", "gnu gpl"]),
    ("gpl-2", "general", ["gnu general public license [version|v] 2", "general public license version 2"]),
    ("gpl-3", "general", ["gnu general public license [version|v] 3", "general public license version 3"]),
    ("gpl", "general", ["gnu general public", "general public"]),
    ("lgpl-2", "lgpl", ["lgpl [version|v] 2 [0]", "lgplv2"]),
    ("lgpl-2.1", "lgpl", ["lgpl [version|v] 2 1", "lgplv2 1"]),
    ("lgpl-3", "lgpl", ["lgpl [version|v] 3 [0]", "lgplv3"]),
    ("lgpl", "lgpl", ["lgpl", "gnu lgpl"]),
    ("lgpl", "lesser", ["gnu lesser general public", "lesser general public"]),
    ("agpl-3", "agpl", ["agpl [version|v] 3 [0]", "agplv3"]),
    ("agpl", "affero", ["gnu affero general public", "affero general public"]),
    ("mpl-1.1", "mpl", ["mpl [version|v] 1 1"]),
    ("mpl-2", "mpl", ["mpl [version|v] 2 [0]"]),
    ("mpl-2", "mozilla", ["mozilla public license [version|v] 2 [0]"]),
    ("mpl", "mozilla", ["mozilla public"]),
    ("epl-1", "epl", ["epl [version|v] 1 [0]"]),
    ("epl-2", "epl", ["epl [version|v] 2 [0]"]),
    ("epl", "eclipse", ["eclipse public"]),
    ("cddl", "cddl", ["cddl [version|v] 1 [0|1]", "cddl"]),
    ("eupl", "eupl", ["eupl [version|v] 1 [1|2]", "eupl"]),
    ("isc", "isc", ["isc"]),
    ("zlib", "zlib", ["zlib", "zlib libpng"]),
    ("bsl-1", "boost", ["boost software", "boost"]),
    ("artistic-2", "artistic", ["artistic [license] 2 [0]"]),
    ("artistic", "artistic", ["artistic", "perl artistic"]),
    ("unlicense", "unlicense", ["unlicense"]),
    ("wtfpl", "wtfpl", ["wtfpl"]),
    ("psf", "python", ["python software foundation", "psf"]),
    ("ofl-1.1", "ofl", ["sil ofl [1 1]", "ofl [1 1]"]),
    ("ofl-1.1", "font", ["sil open font", "open font"]),
    ("cc0", "cc0", ["cc0", "cc0 1 0", "creative commons zero"]),
    ("cc-by", "cc", ["cc by [2|3|4] [0|5]"]),
    ("cc-by-sa", "cc", ["cc by sa [2|3|4] [0|5]"]),
    ("cc-by-nd", "cc", ["cc by nd [2|3|4] [0|5]"]),
    ("cc-by-nc", "cc", ["cc by nc [2|3|4] [0|5]"]),
    ("cc-by-nc-sa", "cc", ["cc by nc sa [2|3|4] [0|5]"]),
    ("cc-by-nc-nd", "cc", ["cc by nc nd [2|3|4] [0|5]"]),
    ("cc-by", "creative", ["creative commons attribution [2|3|4] [0|5]"]),
    ("cc-by-sa", "creative", ["creative commons attribution share|sharealike [alike]"]),
    ("cc-by-nc", "creative", ["creative commons attribution non|noncommercial [commercial]"]),
    ("cc-by-nd", "creative", ["creative commons attribution no|noderivatives [derivatives]"]),
    ("gfdl", "documentation", ["gnu free documentation", "gfdl"]),
    ("odbl", "database", ["open database", "odbl"]),
    ("ncsa", "ncsa", ["university of illinois ncsa", "ncsa"]),
    ("proprietary", "proprietary", ["proprietary"]),
]
#: priority, confidence, text around a name: {} stands for it.
TEMPLATES = [
    (2, 0.95, "licensed|released|distributed|available|published|provided under [the] [terms] [of] [the] {} [license|licence]"),
    (2, 0.9, "under [the] [terms] [of] [the] {} license|licence"),
    (3, 0.85, "spdx license identifier {}"),
    (4, 0.7, "{} license|licence"),
]
#: label, words of the license's own text or of its usual header: best priority. The longest word that must
#: occur is the keyword.
SENTENCES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit", "use of this source code is governed by an mit style license"),
    ("mit", "see [the] license file for [the] [full] mit license"),
    ("mit-0", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("x11", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("x11", "x window system is a trademark of x consortium"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("apache-1", "this product includes software developed by the apache group for use in the apache http server project"),
    ("apache-1", "products derived from this software may not be called apache nor may apache appear in their name"),
    ("apache-1", "this product includes software developed by the apache software foundation"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http|https www apache org licenses license 2 0"),
    ("apache-2", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license"),
    ("apache-2", "you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("apache-2", "the asf licenses this file to you under the apache license version 2 0"),
    ("apache-2", "http|https www apache org licenses license 2 0 [txt|html]"),
    ("apache-2", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "use of this source code is governed by a bsd style license that can be found in the license file"),
    ("bsd-2-clause", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd-2-clause", "the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies"),
    ("bsd-3-clause", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"),
    ("bsd-3-clause", "neither the name of the university nor the names of its contributors may be used to endorse or promote"),
    ("bsd-3-clause", "the name of the author may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-4-clause", "this product includes software developed by the university of california berkeley and its contributors"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "gnu general public license for more details"),
    ("gpl", "this program comes with absolutely no warranty for details type show w"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", "http|https www gnu org licenses gpl [html|txt]"),
    ("gpl", "module license gpl"),
    ("gpl-1", "under the terms of the gnu general public license as published by the free software foundation either version 1"),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-2", "under the terms of the gnu general public license version 2 [only] as published by the free software foundation"),
    ("gpl-2", "51 franklin street fifth floor boston ma 02110 1301"),
    ("gpl-2", "59 temple place suite 330 boston ma 02111 1307"),
    ("gpl-2", "http|https www gnu org licenses old licenses gpl 2 0"),
    ("gpl-2", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-2", "activities other than copying distribution and modification are not covered by this license they are outside its scope"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-3", "under the terms of the gnu general public license version 3 [only] as published by the free software foundation"),
    ("gpl-3", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3", "to convey a work means any kind of propagation that enables other parties to make or receive copies"),
    ("gpl-3", "http|https www gnu org licenses gpl 3 0"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library|program"),
    ("lgpl", "gnu lesser general public license for more details"),
    ("lgpl", "http|https www gnu org licenses lgpl [html|txt]"),
    ("lgpl-2", "this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license"),
    ("lgpl-2", "you should have received a copy of the gnu library general public license along with this library"),
    ("lgpl-2.1", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-2.1", "the gnu lesser general public license applies to some specially designated software packages typically libraries"),
    ("lgpl-2.1", "http|https www gnu org licenses old licenses lgpl 2 1"),
    ("lgpl-3", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-3", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("lgpl-3", "http|https www gnu org licenses lgpl 3 0"),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3", "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation"),
    ("agpl-3", "your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program"),
    ("agpl", "http|https www gnu org licenses agpl [3] [0] [html|txt]"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance"),
    ("mpl-1.1", "software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights and limitations"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at http|https mozilla org mpl 2 0"),
    ("mpl-2", "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution"),
    ("epl-1", "http|https www eclipse org legal epl v10 html"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("epl-2", "http|https www eclipse org legal epl 2 0"),
    ("epl", "the accompanying program is provided under the terms of this eclipse public license agreement"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", "when distributing covered code include this cddl header in each file"),
    ("cddl", "you can obtain a copy of the license at usr src opensolaris license"),
    ("eupl", "this european union public licence applies to the work as defined below which is provided under the terms of this licence"),
    ("eupl", "licensed under the eupl version 1 1|2 or as soon they will be approved by the european commission subsequent versions of the eupl"),
    ("zlib", "the origin of this software must not be misrepresented"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("bsl-1", "distributed under the boost software license version 1 0 see accompanying file license_1_0 txt"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsl-1", "http|https www boost org license_1_0 txt"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", "you can redistribute it and or modify it under the same terms as perl itself"),
    ("artistic-2", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("artistic-2", "you are permitted to use the standard version and create and use modified versions for any purpose without restriction"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"),
    ("unlicense", "http|https unlicense org"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("psf", "python software foundation license version 2"),
    ("psf", "this license agreement is between the python software foundation psf and the individual or organization"),
    ("psf", "psf is making python available to licensee on an as is basis"),
    ("psf", "licensed to psf under a contributor agreement"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "the fonts and derivatives however cannot be released under any other type of license"),
    ("ofl-1.1", "this license is copied below and is also available with a faq at http|https scripts sil org ofl"),
    ("ofl-1.1", "neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("cc0", "to the extent possible under law the author|authors|person has|have|who [waived|dedicated] all copyright and related|neighboring"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "http|https creativecommons org publicdomain zero 1 0"),
    ("cc0", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders"),
    ("cc-by", "http|https creativecommons org licenses by 1|2|3|4 0|5"),
    ("cc-by", "licensed under a creative commons attribution 2|3|4 0|5 international|unported|generic license"),
    ("cc-by", "you are free to share copy and redistribute the material in any medium or format"),
    ("cc-by-sa", "http|https creativecommons org licenses by sa 1|2|3|4 0|5"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 2|3|4 0|5 international|unported|generic license"),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("cc-by-sa", "text is available under the creative commons attribution sharealike license"),
    ("cc-by-nd", "http|https creativecommons org licenses by nd 1|2|3|4 0|5"),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-nc", "http|https creativecommons org licenses by nc 1|2|3|4 0|5"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 2|3|4 0|5 international|unported|generic license"),
    ("cc-by-nc", "you may not use the material for commercial purposes"),
    ("cc-by-nc-sa", "http|https creativecommons org licenses by nc sa 1|2|3|4 0|5"),
    ("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike 2|3|4 0|5 international|unported|generic license"),
    ("cc-by-nc-nd", "http|https creativecommons org licenses by nc nd 1|2|3|4 0|5"),
    ("cc-by-nc-nd", "licensed under a creative commons attribution noncommercial noderivatives 2|3|4 0|5 international|unported|generic license"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", "a copy of the license is included in the section entitled gnu free documentation license"),
    ("odbl", "this database|data is made available under the open database license http|https opendatacommons org licenses odbl"),
    ("odbl", "any rights in individual contents of the database are licensed under the database contents license"),
    ("odbl", "http|https opendatacommons org licenses odbl [1] [0]"),
    ("ncsa", "to deal with the software without restriction including without limitation the rights to use"),
    ("ncsa", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission the software is provided as is"),
    ("ncsa", "llvm release license"),
    ("public-domain", "released|dedicated|placed into|to|in the public domain"),
    ("public-domain", "this work is in the public domain"),
    ("public-domain", "the author hereby disclaims copyright to this source code"),
    ("public-domain", "no copyright is claimed and this work is in the public domain"),
    ("public-domain", "this is a work of the u s government and is not subject to copyright protection"),
    ("proprietary", "all rights reserved"),
    ("proprietary", "this software is the confidential and proprietary information of"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "no part of this publication may be reproduced stored in a retrieval system or transmitted in any form or by any means"),
    ("proprietary", "reproduction in whole or in part without [prior] [written] permission|consent is prohibited"),
    ("proprietary", "proprietary and confidential"),
    ("proprietary", "may not be used copied reproduced or disclosed without the prior written consent of"),
    ("proprietary", "by installing copying or otherwise using the software you agree to be bound by the terms of this end user license agreement"),
    ("proprietary", "this material may not be published broadcast rewritten or redistributed"),
    ("proprietary", "reverse engineer decompile or disassemble the software"),
    ("bsl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("bsl-1.1", "business source license 1 1"),
    ("sspl-1", "server side public license [version] [1]"),
    ("sspl-1", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2", "elastic license 2 0"),
    ("elastic-2", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "commons clause license condition v1 0"),
    ("ms-pl", "microsoft public license ms pl"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("cecill", "free software license agreement cecill"),
    ("cecill", "this software is governed by the cecill [b|c] license under french law and abiding by the rules of distribution of free software"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "this product includes cryptographic software written by eric young"),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("libpng", "the png reference library is supplied as is"),
    ("afl-3", "licensed under the academic free license version 3 0"),
    ("osl-3", "licensed under the open software license version 3 0"),
    ("upl-1", "the universal permissive license upl version 1 0"),
    ("blueoak-1", "blue oak model license"),
    ("vim", "vim is charityware you can use and copy it as much as you like"),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("json", "the software shall be used for good not evil"),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("php-3", "this product includes php software freely available from"),
    ("ruby", "you can redistribute it and or modify it under either the terms of the 2 clause bsdl"),
    ("tcl", "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("w3c", "this work is being provided by the copyright holders under the following license"),
    ("zpl-2", "zope public license zpl version 2"),
]
#: Labels whose bare name is a signature by itself: no common word, no name of anything else.
BARE = {"cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd", "cc0", "wtfpl", "gfdl", "agpl-3", "gpl-2", "gpl-3", "lgpl-3", "lgpl-2.1"}


def pattern(words: str) -> str:
    """A regular expression over the spaced form: `[x]` optional, `a|b` either."""
    out = []
    for word in words.split():
        optional = word.startswith("[")
        choices = word.strip("[]").split("|")
        one = f" {choices[0]} " if len(choices) == 1 else "(?:" + "|".join(f" {c} " for c in choices) + ")"
        out.append(f"(?:{one})?" if optional else one)
    return "".join(out)


def gate_word(word: str, name: str) -> str:
    """The family's keyword if the name must hold it, else the name's own longest word that must occur."""
    fixed = [w for w in name.split() if not w.startswith("[") and "|" not in w]
    return word if word in fixed else max(fixed, key=len)


def signature_rules() -> list[tuple[int, str, str, str, int, float]]:
    """(rule, label, keyword, regex, priority, confidence), ordered best first; a few hundred."""
    rules = [(label, gate_word("", text), pattern(text), 1, 1.0) for label, text in SENTENCES]
    for priority, confidence, around in TEMPLATES:
        rules += [(label, gate_word(word, name), pattern(around.replace("{}", name)), priority, confidence) for label, word, names in FAMILIES for name in names]
    rules += [(label, gate_word(word, name), pattern(name), 5, 0.5) for label, word, names in FAMILIES if label in BARE for name in names]
    return [(i, *r) for i, r in enumerate(rules)]


def spaced(text: Column) -> Column:
    """Lower-cased words, two blanks before, between and after them.

    lower() is much faster than translate(); of the letters beyond A-Z that it changes, only two
    turn into ASCII letters, so these are put out of its way. No count or match sees the others.
    """
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\ufffd")), F.lit("\u0130"), F.lit("\ufffd"))
    return F.regexp_replace(F.concat(F.lit("  "), F.lower(plain), F.lit("  ")), NOT_WORD, "  ")


def keyword_gate(words: list[str]) -> str:
    """One expression for any of the words, branched by first letter."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    return " (?:" + "|".join(f"{k}(?:{'|'.join(v)})" for k, v in sorted(by.items())) + ") "


def gaps(c: Column) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit("  "), F.lit("")))) / 2).cast("long")


def scanned(docs: DataFrame) -> DataFrame:
    """A written table of all rows, from one pass over their texts: row, doc_id, n_words, s0, s1, ... (for each base
    phrase the parts of the text between its places, in words) and places (of each rule that matches: rule, label,
    priority, confidence, lengths of the stretches between matches, lengths of the matches). Texts are not in it."""
    rules = signature_rules()
    columns = ("rule", "label", "word", "regex", "priority", "confidence")
    listed = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, r)]) for r in rules])
    words = sorted({r[2] for r in rules})
    text = F.col("text")
    rows = docs.select("doc_id", spaced(text).alias("text"))
    here = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, F.concat(F.lit(" "), w, F.lit(" "))))
    rows = rows.withColumn("words", F.when(text.rlike(keyword_gate(words)), here))
    # Rules that put a name in the midst of other words need one of those words, too.
    named = F.contains(text, F.lit(" licen")) | F.contains(text, F.lit(" under "))
    ready = F.filter(listed, lambda r: F.array_contains("words", r["word"]) & (named | ~r["priority"].isin(2, 3, 4)) & F.regexp_like(text, r["regex"]))
    lengths = lambda parts: F.transform(parts, lambda x: F.length(x))
    place = lambda r: F.struct(
        r["rule"].alias("rule"), r["label"].alias("label"), r["priority"].alias("priority"), r["confidence"].alias("confidence"),
        lengths(F.split(text, r["regex"], F.lit(-1))).alias("gaps"), lengths(F.regexp_extract_all(text, r["regex"], F.lit(0))).alias("sizes"),
    )
    base = [F.when(F.contains(text, F.lit(pattern(p))), F.transform(F.split(text, pattern(p), -1), gaps)).alias(f"s{i}") for i, (p, _) in enumerate(BASE_PHRASES)]
    n_words = F.greatest(gaps(text) - 1, F.lit(0)).alias("n_words")
    places = F.when(F.col("words").isNotNull(), F.transform(ready, place)).alias("places")
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", n_words, *base, places), "license-rows")


def survivors(rows: DataFrame) -> DataFrame:
    """Matches of scanned rows that no better one suppresses: row, doc_id, rule, label, confidence, start, end (characters of the spaced form)."""
    each = rows.select("row", "doc_id", F.explode("places").alias("p")).select("row", "doc_id", "p.*")
    each = each.select("row", "doc_id", "rule", "label", "priority", "confidence", F.posexplode(F.arrays_zip("gaps", "sizes")).alias("at", "z"))
    upto = Window.partitionBy("row", "rule").orderBy("at")
    size = F.coalesce("z.sizes", F.lit(0))
    placed = each.withColumn("end", F.sum(F.col("z.gaps") + size).over(upto)).withColumn("size", size).where("size > 0").withColumn("start", F.col("end") - F.col("size"))
    # Interval containment in one pass a priority: seen from the left, longest first, a match is
    # contained if an earlier one of its or a better priority ends no earlier; of equal intervals
    # the better priority comes first, then the smaller rule.
    reach = Window.partitionBy("row").orderBy("start", F.col("end").desc(), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r[4] for r in signature_rules()})
    for p in levels:
        placed = placed.withColumn(f"to{p}", F.max(F.when(F.col("priority") <= p, F.col("end"))).over(reach))
    within = F.coalesce(*[F.when(F.col("priority") == p, F.coalesce(F.col(f"to{p}") >= F.col("end"), F.lit(False))) for p in levels])
    return placed.where(~within).select("row", "doc_id", "rule", "label", "confidence", "start", "end")


def detections(docs: DataFrame) -> DataFrame:
    """Surviving matches of documents: row, doc_id, rule, label, confidence, start, end."""
    return survivors(scanned(docs))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    rows = scanned(docs)
    counts, first, last, labels = [], [], [], []
    for i, (phrase, label) in enumerate(BASE_PHRASES):
        s, n = F.col(f"s{i}"), F.coalesce(F.size(f"s{i}") - 1, F.lit(0))
        counts.append(n)
        first.append(F.when(n > 0, F.get(s, F.lit(0))))
        last.append(F.when(n > 0, F.col("n_words") - len(phrase.split()) - F.get(s, n)))
        labels.append(F.when(n > 0, F.lit(label)))
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))
    more = survivors(rows).groupBy(F.col("row").alias("found")).agg(F.collect_set("label").alias("more"), F.max("confidence").alias("best"))
    out = rows.select(
        "row", "doc_id", "n_words", sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        F.least(*first).cast("long").alias("first_word"), F.greatest(*last).cast("long").alias("last_word"), base.alias("base"),
    ).join(more, F.col("row") == F.col("found"), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"),
    )


def scan_sql() -> str:
    """The same result in SQL for another engine, from the same rules."""
    def q(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    rules = ",\n".join(f"({i}, {q(label)}, {q(' ' + word + ' ')}, {q(regex)}, {p}, CAST({c} AS DOUBLE))" for i, label, word, regex, p, c in signature_rules())
    gap = "CAST((length({0}) - length(replace({0}, '  ', ''))) / 2 AS BIGINT)"
    split = ", ".join(f"CASE WHEN contains(t, {q(pattern(p))}) THEN string_split(t, {q(pattern(p))}) END AS s{i}" for i, (p, _) in enumerate(BASE_PHRASES))
    n = " + ".join(f"coalesce(len(s{i}) - 1, 0)" for i in range(len(BASE_PHRASES)))
    first = ", ".join(gap.format(f"s{i}[1]") for i in range(len(BASE_PHRASES)))
    last = ", ".join(f"nw - {len(p.split())} - {gap.format(f's{i}[-1]')}" for i, (p, _) in enumerate(BASE_PHRASES))
    base = ", ".join(f"CASE WHEN s{i} IS NOT NULL THEN {q(label)} END" for i, (_, label) in enumerate(BASE_PHRASES))
    return f"""
WITH rules(rule, label, word, regex, priority, confidence) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_replace('  ' || translate(coalesce(text, ''), '{UPPER}', '{LOWER}') || '  ', '{NOT_WORD}', '  ', 'g') AS t FROM documents),
m AS (SELECT r, rule, label, priority, confidence, regexp_extract_all(t, regex) AS a, string_split_regex(t, regex) AS p
  FROM d JOIN rules ON contains(t, word)),
e AS (SELECT r, rule, label, priority, confidence, a, p, unnest(generate_series(1, len(a))) AS i FROM m WHERE len(a) > 0),
x AS (SELECT r, rule, label, priority, confidence, length(a[i]) AS n,
  list_sum(list_transform(p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(a[1:i-1], lambda y: length(y))), 0) AS b FROM e),
k AS (SELECT r, label, confidence FROM x WHERE NOT EXISTS (SELECT 1 FROM x z WHERE z.r = x.r AND z.b <= x.b AND z.b + z.n >= x.b + x.n
  AND (z.priority < x.priority OR z.priority = x.priority AND (z.n > x.n OR z.n = x.n AND z.rule < x.rule)))),
g AS (SELECT r, list(DISTINCT label) AS more, max(confidence) AS best FROM k GROUP BY r),
s AS (SELECT r, doc_id, greatest({gap.format('t')} - 1, 0) AS nw, {split} FROM d),
b AS (SELECT r, doc_id, nw, {n} AS nb, least({first}) AS f, greatest({last}) AS l,
  list_sort(list_distinct(list_filter([{base}], lambda y: y IS NOT NULL))) AS lab FROM s)
SELECT doc_id, CAST(nw AS BIGINT) AS n_words, CAST(nb AS BIGINT) AS n_base, CAST(f AS BIGINT) AS first_word, CAST(l AS BIGINT) AS last_word,
  array_to_string(lab, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(lab, coalesce(more, [])))), ',') AS labels,
  CASE WHEN nb > 0 THEN CAST(1.0 AS DOUBLE) ELSE coalesce(best, CAST(0.0 AS DOUBLE)) END AS score
FROM b LEFT JOIN g USING (r)"""
