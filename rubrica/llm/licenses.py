"""License scan: ordered signature rules behind a keyword gate.

A text becomes its lower-case words, joined by single blanks. Only rules whose keyword is among those words run. Each
rule is a regular expression with a priority; a detection that lies inside one of higher priority, or inside a longer or
earlier rule's one of the same, is suppressed. Guards are rules without a label for mentions that grant nothing: they only
suppress. Four fixed phrases (``PHRASES``) are counted apart,
and their labels always stay.

Nulls count as empty texts; an empty text has no words, labels or detections and score 0. Rows are independent, so
repeated rows give equal results, and an empty table gives an empty result. Long texts are scanned whole, in time that grows
with their length and hits. Other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import bisect
import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import arrow_map, table, texts_of

#: Fixed values of the contract: phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
PLAIN = re.compile(r"\w+")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

#: label; keywords that gate it (each match holds one of them as a word); the license's name in words, as it is written in prose; its identifier in words.
FAMILIES = [
    ("0bsd", "bsd 0bsd", r"(?:zero clause bsd|0 ?clause bsd|bsd zero clause|0bsd)", r"0bsd"),
    ("afl-3.0", "academic afl", r"academic free license(?: (?:version )?v?3(?: 0)?)?", r"afl 3 0"),
    ("agpl-3.0", "affero agpl agpl3 agplv3", r"(?:gnu )?(?:affero general public licen[sc]e|agpl)(?: version| v)? ?v?3(?: 0)?", r"agpl 3 0"),
    ("agpl-1.0", "affero agpl", r"affero general public licen[sc]e(?: version| v)? ?v?1(?: 0)?", r"agpl 1 0"),
    ("agpl", "affero agpl", r"(?:gnu )?(?:affero general public licen[sc]e|agpl)", r"agpl"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[sc]e(?: version| v)? ?v?1 1", r"apache 1 1"),
    ("apache-2.0", "apache asl asl2", r"(?:apache (?:software )?licen[sc]e(?: version| v)? ?v?2(?: 0)?|asl ?2(?: 0)?)", r"apache 2 0"),
    ("apsl-2.0", "apple apsl", r"apple public source licen[sc]e(?: (?:version )?v?2(?: 0)?)?", r"apsl 2 0"),
    ("artistic-1.0", "artistic", r"artistic licen[sc]e(?: version| v)? ?v?1(?: 0)?", r"artistic 1 0"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e(?: version| v)? ?v?2(?: 0)?", r"artistic 2 0"),
    ("beerware", "beer beerware", r"(?:beer ?ware licen[sc]e|buy me a beer)", r"beerware"),
    ("bsd-2-clause", "bsd freebsd", r"(?:(?:2|two) clause bsd|simplified bsd|freebsd licen[sc]e|bsd (?:2|two) clause)", r"bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:(?:3|three) clause bsd|(?:new|modified|revised) bsd|bsd (?:3|three) clause)", r"bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:(?:4|four) clause bsd|(?:original|old) bsd|bsd (?:4|four) clause)", r"bsd 4 clause"),
    ("bsd", "bsd", r"bsd (?:style )?licen[sc]e", r"bsd"),
    ("bsl-1.0", "boost bsl", r"boost software licen[sc]e(?: (?:version )?v?1(?: 0)?)?", r"bsl 1 0"),
    ("busl-1.1", "business busl", r"business source licen[sc]e(?: (?:version )?v?1 1)?", r"busl 1 1"),
    ("cc-by-3.0", "cc creative", r"(?:cc by|creative commons attribution)(?: licen[sc]e)?(?: version)? ?v?3 0", r"cc by 3 0"),
    ("cc-by-4.0", "cc creative", r"(?:cc by|creative commons attribution)(?: international)?(?: licen[sc]e)?(?: version)? ?v?4 0", r"cc by 4 0"),
    ("cc-by", "cc creative", r"creative commons attribution(?: licen[sc]e)?", r"cc by"),
    ("cc-by-sa-3.0", "cc creative", r"(?:cc by sa|creative commons attribution share ?alike) ?v?3 0", r"cc by sa 3 0"),
    ("cc-by-sa-4.0", "cc creative", r"(?:cc by sa|creative commons attribution share ?alike) ?v?4 0", r"cc by sa 4 0"),
    ("cc-by-sa", "cc creative", r"(?:cc by sa|creative commons attribution share ?alike)", r"cc by sa"),
    ("cc-by-nc", "cc creative", r"(?:cc by nc|creative commons attribution non ?commercial)", r"cc by nc"),
    ("cc-by-nc-sa", "cc creative", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", r"cc by nc sa"),
    ("cc-by-nc-nd", "cc creative", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative|ativ)?(?:e?s)?)", r"cc by nc nd"),
    ("cc-by-nd", "cc creative", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)", r"cc by nd"),
    ("cc0-1.0", "cc0 creative", r"(?:cc0|creative commons zero)(?: (?:version )?v?1(?: 0)?)?", r"cc0 1 0"),
    ("cddl-1.0", "cddl development", r"(?:common development and distribution licen[sc]e|cddl)(?: (?:version )?v?1 0)?", r"cddl 1 0"),
    ("cddl-1.1", "cddl development", r"(?:common development and distribution licen[sc]e|cddl) (?:version )?v?1 1", r"cddl 1 1"),
    ("cecill-2.1", "cecill", r"cecill(?: free software)?(?: licen[sc]e)?(?: agreement)?(?: (?:version )?v?2 1)?", r"cecill 2 1"),
    ("cpl-1.0", "common cpl", r"common public licen[sc]e(?: (?:version )?v?1(?: 0)?)?", r"cpl 1 0"),
    ("ecl-2.0", "educational ecl", r"educational community licen[sc]e(?: (?:version )?v?2(?: 0)?)?", r"ecl 2 0"),
    ("epl-1.0", "eclipse epl", r"eclipse public licen[sc]e(?: (?:version )?v| version)? ?v?1(?: 0)?", r"epl 1 0"),
    ("epl-2.0", "eclipse epl", r"eclipse public licen[sc]e(?: (?:version )?v| version)? ?v?2(?: 0)?", r"epl 2 0"),
    ("eupl-1.2", "eupl european", r"(?:european union public licen[sc]e|eupl)(?: (?:version )?v?1 2)?", r"eupl 1 2"),
    ("gfdl-1.3", "documentation gfdl", r"(?:gnu )?free documentation licen[sc]e(?: (?:version )?v?1 3)?", r"gfdl 1 3"),
    ("gpl-1.0", "gpl general gpl1 gplv1", r"(?:gnu )?(?:general public licen[sc]e|gpl)(?: version| v)? ?v?1(?: 0)?", r"gpl 1 0"),
    ("gpl-2.0", "gpl general gpl2 gplv2", r"(?:gnu )?(?:general public licen[sc]e|gpl)(?: version| v)? ?v?2(?: 0)?|gplv2", r"gpl 2 0"),
    ("gpl-3.0", "gpl general gpl3 gplv3", r"(?:gnu )?(?:general public licen[sc]e|gpl)(?: version| v)? ?v?3(?: 0)?|gplv3", r"gpl 3 0"),
    ("gpl", "gpl gnu", r"(?:gnu (?:general public licen[sc]e|gpl)|gpl licen[sc]e)", r"gpl"),
    ("icu", "icu unicode", r"(?:icu licen[sc]e|unicode license agreement)", r"icu"),
    ("ijg", "jpeg ijg", r"independent jpeg group", r"ijg"),
    ("isc", "isc", r"isc licen[sc]e", r"isc"),
    ("lgpl-2.0", "lgpl library lgpl2 lgplv2", r"(?:gnu )?(?:library general public licen[sc]e|lgpl)(?: version| v)? ?v?2(?: 0)", r"lgpl 2 0"),
    ("lgpl-2.1", "lgpl lesser lgpl2 lgplv2", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl)(?: version| v)? ?v?2 1", r"lgpl 2 1"),
    ("lgpl-3.0", "lgpl lesser lgpl3 lgplv3", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl)(?: version| v)? ?v?3(?: 0)?", r"lgpl 3 0"),
    ("lgpl", "lgpl lesser", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl)", r"lgpl"),
    ("libpng", "libpng png", r"(?:libpng|png reference library) licen[sc]e", r"libpng"),
    ("lppl-1.3c", "latex lppl", r"latex project public licen[sc]e(?: (?:version )?v?1 3c?)?", r"lppl 1 3c"),
    ("mit", "mit expat x11", r"(?:(?:mit|expat) (?:style )?licen[sc]e|x11 licen[sc]e|licen[sc]e mit)", r"mit"),
    ("mit-0", "mit", r"mit (?:no attribution|0)(?: licen[sc]e)?", r"mit 0"),
    ("mpl-1.1", "mozilla mpl mpl1 mplv1", r"(?:mozilla public licen[sc]e|mpl)(?: version| v)? ?v?1 1", r"mpl 1 1"),
    ("mpl-2.0", "mozilla mpl mpl2 mplv2", r"(?:mozilla public licen[sc]e|mpl)(?: version| v)? ?v?2(?: 0)?", r"mpl 2 0"),
    ("mpl", "mozilla mpl", r"mozilla public licen[sc]e", r"mpl"),
    ("ms-pl", "microsoft ms", r"microsoft public licen[sc]e", r"ms pl"),
    ("ms-rl", "microsoft ms", r"microsoft reciprocal licen[sc]e", r"ms rl"),
    ("ncsa", "ncsa illinois", r"(?:university of illinois|uiuc) ncsa open source licen[sc]e", r"ncsa"),
    ("odbl-1.0", "database odbl", r"open (?:data commons )?(?:open )?database licen[sc]e(?: (?:version )?v?1(?: 0)?)?", r"odbl 1 0"),
    ("ofl-1.1", "font ofl", r"(?:sil )?open font licen[sc]e(?: (?:version )?v?1 1)?", r"ofl 1 1"),
    ("openssl", "openssl", r"openssl licen[sc]e", r"openssl"),
    ("osl-3.0", "open osl", r"open software licen[sc]e(?: (?:version )?v?3(?: 0)?)?", r"osl 3 0"),
    ("php-3.01", "php", r"php licen[sc]e(?: (?:version )?v?3 0?1)?", r"php 3 01"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", r"postgresql"),
    ("psf-2.0", "psf python", r"python software foundation licen[sc]e(?: (?:version )?v?2)?", r"(?:psf|python) 2 0"),
    ("public-domain", "domain", r"(?:(?:released|placed|dedicated) (?:in)?to the public domain|public domain dedication)", r"public domain"),
    ("qpl-1.0", "qpl q", r"q public licen[sc]e(?: (?:version )?v?1(?: 0)?)?", r"qpl 1 0"),
    ("sspl-1.0", "sspl server", r"server side public licen[sc]e(?: (?:version )?v?1(?: 0)?)?", r"sspl 1 0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense"),
    ("upl-1.0", "upl universal", r"universal permissive licen[sc]e(?: (?:version )?v?1(?: 0)?)?", r"upl 1 0"),
    ("vim", "vim", r"vim licen[sc]e", r"vim"),
    ("w3c", "w3c", r"w3c software (?:notice and )?licen[sc]e", r"w3c"),
    ("wtfpl", "wtfpl want", r"(?:wtfpl|do what the f\w+ you want to public licen[sc]e)", r"wtfpl"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", r"zlib"),
    ("zpl-2.1", "zope zpl", r"zope public licen[sc]e(?: (?:version )?v?2 1)?", r"zpl 2 1"),
]

#: Hand-written rules: priority; label (empty for a guard, which only suppresses); keywords, of which every match holds one as a word; expression.
RULE_LIST = [
    # a license's own text
    (4, "apache-2.0", "compliance", r"you may not use this file except in compliance with the license(?: .{0,200}?apache org licenses license 2 0)?"),
    (4, "apache-2.0", "derivative", r"derivative works shall not include works that remain separable from or merely link"),
    (4, "apache-2.0", "contributor", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    (3, "apache-2.0", "attribution", r"you must retain in the source form of any derivative works that you distribute all copyright patent trademark and attribution notices"),
    (4, "apache-1.1", "acknowledgment acknowledgement", r"the end user documentation included with the redistribution if any must include the following acknowledge?ment"),
    (4, "bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    (3, "bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    (3, "bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    (4, "bsd-3-clause", "neither", r"neither the name of .{1,80}? nor the names of its contributors may be used to endorse"),
    (4, "bsd-3-clause", "neither", r"neither the names? of the copyright holders? nor the names of (?:its|their) contributors may be used"),
    (4, "bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software"),
    (4, "bsd-2-clause-patent", "contributor", r"each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual"),
    (4, "bsd-3-clause-clear", "patent", r"no express or implied licenses to any party s patent rights are granted by this license"),
    (4, "bsd-3-clause-no-nuclear", "nuclear", r"you acknowledge that this software is not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility"),
    (4, "0bsd", "fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    (4, "bsl-1.0", "organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    (3, "bsl-1.0", "object", r"solely in the form of machine executable object code generated by a source language processor"),
    (4, "gpl", "redistribute", r"redistribute it and or modify it under the terms of the gnu general public license"),
    (4, "gpl-or-later", "option", r"either version \d(?: \d)? of the license or at your option any later version"),
    (3, "gpl", "freedom", r"the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change"),
    (3, "gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    (4, "gpl-2.0", "boston", r"foundation inc (?:51|59) (?:franklin street fifth floor|temple place suite 330) boston ma"),
    (4, "gpl-3.0", "propagate", r"to propagate a work means to do anything with it that without permission would make you directly or secondarily liable"),
    (4, "gpl-3.0", "tivoization", r"tivoization is not (?:allowed|permitted) under (?:gpl )?v?(?:ersion )?3"),
    (3, "gpl-3.0", "installation", r"installation information for a user product means any methods procedures authorization keys"),
    (4, "lgpl", "lesser", r"redistribute it and or modify it under the terms of the gnu lesser general public license"),
    (4, "lgpl-2.0", "library", r"redistribute it and or modify it under the terms of the gnu library general public license"),
    (3, "lgpl-2.1", "library", r"a program that contains no derivative of any portion of the library but is designed to work with the library"),
    (3, "lgpl-3.0", "combined", r"a combined work is a work produced by combining or linking an application with the library"),
    (4, "agpl-3.0", "remotely", r"prominently offer all users interacting with it remotely through a computer network"),
    (4, "agpl", "affero", r"redistribute it and or modify it under the terms of the gnu affero general public license"),
    (4, "gfdl-1.3", "invariant", r"with no invariant sections (?:with )?no front cover texts and (?:with )?no back cover texts"),
    (4, "gfdl-1.3", "documentation", r"copy distribute and or modify this document under the terms of the gnu free documentation license"),
    (4, "isc", "fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    (4, "hpnd", "fee", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee"),
    (4, "mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    (3, "mit", "substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    (3, "mit", "merge", r"rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    (4, "x11", "advertising", r"except as contained in this notice the name of .{1,60}? shall not be used in advertising or otherwise to promote"),
    (4, "json", "evil", r"the software shall be used for good not evil"),
    (4, "mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    (4, "mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    (3, "mpl-1.1", "initial", r"the initial developer of the original code is"),
    (3, "mpl-2.0", "incompatible", r"this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    (4, "npl-1.1", "netscape", r"the contents of this file are subject to the netscape public license"),
    (4, "cddl-1.0", "development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    (4, "epl-2.0", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0"),
    (4, "epl-1.0", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license v ?1 0"),
    (3, "epl", "secondary", r"this source code may also be made available under the following secondary licenses"),
    (4, "edl-1.0", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse distribution license v ?1 0"),
    (4, "unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    (3, "unlicense", "relinquishment", r"overt act of relinquishment in perpetuity of all present and future rights to this software"),
    (4, "wtfpl", "verbatim", r"everyone is permitted to copy and distribute verbatim or modified copies .{0,40}?wtfpl"),
    (4, "wtfpl", "want", r"you just do what the \w+ you want to"),
    (4, "zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    (3, "zlib", "altered", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    (4, "openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    (4, "ssleay", "cryptographic", r"this product includes cryptographic software written by eric young"),
    (4, "php-3.01", "php", r"this product includes php software freely available from"),
    (4, "artistic-2.0", "artistic", r"this (?:package|library|program) is free software (?:you|and may be)(?: \w+){0,10}? artistic license(?: version)? 2 0"),
    (3, "artistic-1.0", "artistic", r"(?:under|by) the same terms as perl itself(?: \w+){0,13}? artistic license"),
    (4, "perl", "perl", r"(?:redistribute it and or modify it )?under the same terms as perl itself"),
    (4, "ruby", "ruby", r"(?:you can redistribute it and or modify it|licensed|distributed) under (?:the )?(?:same terms as|terms of) ruby(?: s)?"),
    (4, "python-2.0", "psf", r"psf is making python available to licensee on an as is basis"),
    (3, "python-2.0", "cnri", r"cnri hereby grants licensee a nonexclusive royalty free world wide license"),
    (4, "ofl-1.1", "font", r"this font software is licensed under the sil open font license"),
    (3, "ofl-1.1", "reserved", r"no modified version of the font software may use the reserved font name"),
    (4, "cc0-1.0", "waived", r"has waived all copyright and related or neighboring rights to this work"),
    (3, "cc0-1.0", "affirmer", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    (4, "cc-by", "attribution", r"this work is licensed under a creative commons attribution (?:\d 0 )?(?:international |unported |generic )?licen[sc]e"),
    (4, "cc-by-sa", "sharealike alike", r"this work is licensed under a creative commons attribution share ?alike"),
    (4, "cc-by-nc", "noncommercial commercial", r"this work is licensed under a creative commons attribution non ?commercial"),
    (4, "cc-by-nd", "noderivatives noderivs derivatives derivs", r"this work is licensed under a creative commons attribution no ?deriv(?:ative)?s"),
    (3, "cc-by-sa", "remix", r"if you remix transform or build upon the material you must distribute your contributions under the same license"),
    (3, "cc-by", "credit", r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    (4, "w3c", "w3c", r"permission to copy modify and distribute this software and its documentation(?: \w+){0,20}? w3c"),
    (4, "boost-original", "boost", r"distributed under the boost software license version 1 0 see accompanying file"),
    (4, "ncsa", "illinois", r"neither the names of .{1,80}? university of illinois(?: \w+){0,13}? nor the names of its contributors"),
    (4, "curl", "curl", r"copyright c .{0,60}?daniel stenberg .{0,60}?all rights reserved permission to use copy modify and distribute(?: \w+){0,13}? curl"),
    (4, "ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    (4, "libtiff", "silicon", r"the names of sam leffler and silicon graphics may not be used in any advertising"),
    (4, "ftl", "freetype", r"portions of this software are copyright .{0,40}?the freetype project"),
    (4, "icu", "unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    (4, "postgresql", "postgresql", r"postgresql (?:database management system|is released under the postgresql license)"),
    (4, "tcl", "regents", r"this software is copyrighted by the regents of the university of california sun microsystems"),
    (4, "beerware", "beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer"),
    (4, "sleepycat", "sleepycat", r"redistributions in any form must be accompanied by information on how to obtain complete source code for the db software(?: \w+){0,33}? sleepycat"),
    (4, "ms-pl", "microsoft", r"this license governs use of the accompanying software(?: \w+){0,33}? microsoft (?:public|permissive) licen[sc]e"),
    (4, "eupl-1.2", "eupl", r"licensed under the eupl(?: version)?(?: v)? 1 [12] or as soon they will be approved by the european commission"),
    (4, "cecill", "cecill", r"this software is governed by the cecill(?: b| c)? licen[sc]e under french law"),
    (4, "sspl-1.0", "sspl", r"making the functionality of the program or modified version available to third parties as a service(?: \w+){0,33}? sspl"),
    (4, "elastic-2.0", "elastic", r"(?:licensed under|governed by) (?:the )?elastic licen[sc]e(?: version)?(?: v)? ?2(?: 0)?"),
    (3, "elastic-2.0", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    (4, "busl-1.1", "change", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use(?: \w+){0,66}? change date"),
    (4, "commons-clause", "commons sell", r"(?:commons clause|the license does not grant to you and you may not sell the software)"),
    (4, "polyform-noncommercial", "polyform", r"polyform non ?commercial licen[sc]e(?: 1 0 0)?"),
    (4, "polyform-shield", "polyform", r"polyform shield licen[sc]e(?: 1 0 0)?"),
    (4, "prosperity", "prosperity", r"prosperity public licen[sc]e(?: 3 0 0)?"),
    (4, "parity", "parity", r"parity public licen[sc]e(?: 7 0 0)?"),
    (4, "blueoak-1.0.0", "oak", r"blue oak model licen[sc]e(?: 1 0 0)?"),
    (4, "osl-3.0", "osl", r"licensed under the open software license version 3 0(?: \w+){0,6}? osl"),
    (4, "rail", "rail openrail", r"(?:creativeml |bigscience |bigcode )?open ?rail(?: m)?(?: licen[sc]e)?"),
    (4, "llama-community", "llama", r"llama \d(?: \d)? (?:community )?licen[sc]e(?: agreement)?"),
    (4, "gemma", "gemma", r"gemma (?:terms of use|licen[sc]e)"),
    (4, "odc-by", "attribution", r"open data commons attribution licen[sc]e(?: v ?1 0)?"),
    (4, "pddl-1.0", "pddl dedication", r"(?:open data commons )?public domain dedication (?:and|&) licen[sc]e|pddl(?: 1 0)?"),
    (4, "cdla-permissive", "cdla community", r"(?:community data licen[sc]e agreement permissive|cdla permissive)(?: (?:version )?[12] 0)?"),
    (4, "cdla-sharing", "cdla community", r"(?:community data licen[sc]e agreement sharing|cdla sharing)(?: (?:version )?1 0)?"),
    (4, "ogl-uk-3.0", "government", r"open government licen[sc]e(?: v| version)? ?3(?: 0)?"),
    (3, "ogl-uk", "government", r"contains public sector information licensed under the open government licen[sc]e"),
    (4, "etalab-2.0", "etalab ouverte", r"(?:etalab |licence ouverte )(?:open licen[sc]e )?(?:v(?:ersion)? ?)?2 0"),
    (4, "dl-de-by-2.0", "deutschland", r"datenlizenz deutschland namensnennung(?: version)? ?2 0"),
    (4, "us-government", "government", r"(?:this )?(?:work|software) (?:is|was) (?:a work of|created by|produced by) (?:the )?(?:united states|u s|us) government"),
    (3, "public-domain", "domain", r"(?:this (?:file|software|work|code|document) is |hereby )(?:placed )?in the public domain"),
    (3, "public-domain", "disclaim disclaims", r"the authors? (?:hereby )?disclaims? (?:all )?copyrights? to this (?:source )?(?:code|file|work)"),
    (3, "public-domain", "blessing", r"the author disclaims copyright to this source code in place of a legal notice here is a blessing"),
    # notices of one sentence
    (4, "mit", "mit", r"(?:this|the) (?:software|project|code|package|library|work|repository) is (?:licensed|released|distributed|available|provided|published) under the mit"),
    (3, "mit", "mit", r"licen[sc]e mit|mit licensed|mit x11"),
    (3, "mit", "mit", r"opensource org licenses mit"),
    (3, "apache-2.0", "apache", r"www apache org licenses license 2 0(?: txt| html)?"),
    (3, "apache-2.0", "apache apache2", r"apache 2(?: 0)? (?:licensed|licen[sc]e)|apache2? licensed"),
    (3, "bsd-3-clause", "bsd", r"opensource org licenses bsd 3 clause"),
    (3, "bsd-2-clause", "bsd", r"opensource org licenses bsd 2 clause"),
    (3, "bsd", "bsd", r"bsd licensed|use of this source code is governed by a bsd style license"),
    (3, "gpl-2.0", "gpl", r"www gnu org licenses (?:old licenses )?gpl 2 0(?: txt| html)?"),
    (3, "gpl-3.0", "gpl", r"www gnu org licenses gpl 3 0(?: txt| html)?"),
    (3, "gpl", "gpl", r"www gnu org (?:licenses|copyleft) gpl(?: txt| html)?"),
    (3, "lgpl", "lgpl", r"www gnu org (?:licenses|copyleft) (?:old licenses )?lgpl(?: [23] [01])?(?: txt| html)?"),
    (3, "agpl-3.0", "agpl", r"www gnu org licenses agpl 3 0(?: txt| html)?"),
    (3, "gpl-2.0", "gpl gpl2 gplv2", r"gpl ?v?2 (?:or later|only|licensed)"),
    (3, "gpl-3.0", "gpl gpl3 gplv3", r"gpl ?v?3 (?:or later|only|licensed)"),
    (3, "gpl-dual", "dual dually", r"dual(?:ly)? licensed under (?:the )?(?:mit|bsd) (?:and|or) (?:the )?gpl"),
    (3, "apache-mit-dual", "dual dually either", r"(?:dual(?:ly)? licensed under (?:the )?|licensed under either of (?:the )?)(?:apache|mit).{0,40}?(?:mit|apache)"),
    (3, "mpl-2.0", "mozilla", r"(?:www )?mozilla org (?:en us )?mpl 2 0"),
    (3, "mpl-2.0", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one"),
    (3, "epl", "eclipse", r"www eclipse org legal epl v[12]0?(?: html)?|www eclipse org legal epl 2 0"),
    (3, "cc0-1.0", "zero", r"creativecommons org publicdomain zero 1 0"),
    (3, "public-domain", "publicdomain", r"creativecommons org publicdomain mark 1 0"),
    (3, "cc-by-4.0", "creativecommons", r"creativecommons org licenses by 4 0"),
    (3, "cc-by-3.0", "creativecommons", r"creativecommons org licenses by 3 0"),
    (3, "cc-by-sa-4.0", "creativecommons", r"creativecommons org licenses by sa 4 0"),
    (3, "cc-by-sa-3.0", "creativecommons", r"creativecommons org licenses by sa 3 0"),
    (3, "cc-by-nc", "creativecommons", r"creativecommons org licenses by nc (?:1|2|3|4) (?:0|5)"),
    (3, "cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa (?:1|2|3|4) (?:0|5)"),
    (3, "cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd (?:1|2|3|4) (?:0|5)"),
    (3, "cc-by-nd", "creativecommons", r"creativecommons org licenses by nd (?:1|2|3|4) (?:0|5)"),
    (3, "ofl-1.1", "ofl", r"scripts sil org ofl"),
    (3, "unlicense", "unlicense", r"(?:www )?unlicense org"),
    (3, "wtfpl", "wtfpl", r"(?:www )?wtfpl net"),
    (3, "bsl-1.0", "boost", r"www boost org license 1 0 txt"),
    (3, "isc", "isc", r"opensource org licenses isc(?: license)?(?: txt)?|isc licensed"),
    (3, "zlib", "zlib", r"(?:www )?zlib net zlib license html"),
    (2, "odbl-1.0", "odbl opendatacommons", r"opendatacommons org licenses odbl|odbl (?:v )?1 0"),
    (2, "gpl", "copyleft", r"(?:strong |weak )?copyleft licen[sc]e"),
    (1, "generic-license", "licence license", r"see (?:the )?licen[sc]e (?:file )?for (?:the )?(?:specific |more )?(?:language|details|information)"),
    (1, "generic-license", "licence license", r"(?:see|refer to|in) the (?:accompanying )?(?:file )?licen[sc]e(?: txt| md)? (?:file )?(?:in|at) the (?:root|top)"),
    (1, "generic-license", "licensed", r"licensed under the terms (?:and conditions )?(?:stated|set out|found) in the (?:accompanying )?(?:license|licence|copying) file"),
    (1, "no-warranty", "warranties warranty", r"provided as is without (?:any )?(?:warranty|warranties)(?: of any kind)?"),
    (1, "no-warranty", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    # works that aren't free
    (2, "proprietary", "reserved", r"all rights reserved"),
    (4, "proprietary", "confidential", r"confidential and proprietary"),
    (4, "proprietary", "trade", r"(?:contains|constitutes?) (?:valuable )?trade secrets? (?:and|or) (?:confidential|proprietary)"),
    (4, "proprietary", "unpublished", r"unpublished rights reserved under the copyright laws"),
    (3, "proprietary", "reverse decompile disassemble", r"you may not (?:decompile|disassemble) .{0,40}?reverse engineer|may not reverse engineer decompile or disassemble"),
    (3, "proprietary", "eula", r"(?:end user licen[sc]e agreement )?eula (?:governs|applies|between)"),
    (3, "proprietary", "internal", r"for internal use only (?:do not|not to be|may not be) (?:distribute|distributed|redistributed|copied)"),
    (3, "no-license", "permission", r"may not be (?:reproduced|copied|distributed) without (?:prior )?(?:written )?permission"),
    (3, "no-license", "reproduced", r"no part of this (?:publication|book|document|work) may be reproduced"),
    (3, "non-commercial", "commercial", r"(?:for|free for) non commercial use only|not for commercial use"),
    (3, "research-only", "research", r"for (?:academic|non commercial) (?:and |or )?research (?:purposes|use) only"),
    (2, "shareware", "shareware", r"this (?:program|software) is shareware"),
    (2, "freeware", "freeware", r"this (?:program|software) is freeware|freeware licen[sc]e"),
    # exceptions
    (4, "classpath-exception-2.0", "classpath", r"(?:gnu )?classpath (?:linking )?exception|with the classpath exception"),
    (3, "classpath-exception-2.0", "linking", r"linking this library statically or dynamically with other modules is making a combined work"),
    (4, "gcc-exception-3.1", "gcc", r"gcc runtime library exception"),
    (4, "llvm-exception", "llvm", r"(?:apache (?:license )?(?:version |v)?2 0 with )?llvm exceptions?"),
    (4, "autoconf-exception", "autoconf", r"autoconf (?:configure script )?exception|if you distribute this file as part of a program that contains a configuration script generated by autoconf"),
    (4, "bison-exception-2.2", "bison", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    (4, "libtool-exception", "libtool", r"if you distribute this file as part of a program (?:or library )?that is built using gnu libtool"),
    (4, "openssl-exception", "openssl", r"(?:as a special exception .{0,80}?)?permission to link (?:the code of )?.{0,60}?with the openssl library|openssl (?:linking )?exception"),
    (4, "font-exception-2.0", "font", r"as a special exception if you create a document which uses this font"),
    (4, "linux-syscall-note", "kernel", r"this copyright does not cover user programs that use kernel services by normal system calls|linux kernel syscall (?:note|exception)"),
    (4, "swift-exception", "swift", r"swift runtime library exception|runtime library exception to the apache(?: \w+){0,10}? swift"),
    (4, "universal-foss-exception", "foss", r"universal foss exception"),
    (4, "wxwindows-exception", "wxwindows wxwidgets", r"(?:wxwindows|wxwidgets) (?:library )?(?:licen[sc]e|licen[sc]e exception|exception)"),
    (4, "u-boot-exception", "boot", r"u boot (?:licen[sc]e )?exception"),
    (4, "ocaml-lgpl-exception", "ocaml", r"ocaml lgpl linking exception"),
    (4, "qt-lgpl-exception", "qt", r"(?:nokia|digia) qt lgpl exception"),
    (4, "ecos-exception-2.0", "ecos", r"ecos (?:licen[sc]e )?exception"),
    (4, "mif-exception", "macros", r"if other files instantiate templates or use macros or inline functions from this file"),
    (4, "readline-exception", "readline", r"readline exception"),
    (4, "cryptsetup-openssl-exception", "cryptsetup", r"cryptsetup openssl exception"),
    (3, "gpl-exception", "exception", r"as a special exception(?: to the gnu (?:lesser |library )?general public license)?"),
    # guards: mentions that grant nothing
    (6, "", "not", r"(?:is|are|was|were) not (?:licen[sc]ed|available|released|distributed|covered|published) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:\w+ ){1,6}?(?:licen[sc]e|gpl|lgpl|agpl|mpl)"),
    (6, "", "driver drivers driving", r"(?:driver|drivers|driving) (?:s )?licen[sc]es?"),
    (6, "", "plate plates", r"(?:mit |bsd |apache )?licen[sc]e plates?"),
    (6, "", "fishing hunting marriage liquor pilot", r"(?:fishing|hunting|marriage|liquor|pilot)(?: s)? licen[sc]es?"),
    (6, "", "incompatible", r"incompatible with (?:the )?(?:gnu )?(?:gpl|general public licen[sc]e|apache licen[sc]e|mit licen[sc]e|lgpl)(?: v?\d(?: \d)?)?"),
    (6, "", "violation violations", r"(?:gnu )?(?:gpl|general public licen[sc]e) (?:licen[sc]e )?violations?"),
    (6, "", "violates violating violated", r"violat(?:es|ing|ed) the (?:gnu )?(?:gpl|general public licen[sc]e|apache licen[sc]e)"),
    (6, "", "compare compared versus vs", r"(?:gpl|mit|bsd|apache|lgpl)(?: licen[sc]e)? (?:compared (?:to|with)|versus|vs) (?:the )?(?:gpl|mit|bsd|apache|lgpl)(?: licen[sc]e)?"),
    (6, "", "unlike", r"unlike (?:the )?(?:gnu )?(?:gpl|general public licen[sc]e|mit licen[sc]e|bsd licen[sc]e|apache licen[sc]e)"),
    (6, "", "public", r"in the public domain of (?:knowledge|debate|opinion)"),
    (6, "", "artistic poetic", r"(?:took|take|taking|takes|with) (?:some |an )?(?:artistic|poetic) licen[sc]e"),
    (6, "", "example", r"for example (?:the )?(?:mit|bsd|apache|gpl) licen[sc]e"),
]

#: Priority: weight of a detection of it in the score. Guards, of priority 6, have none.
WEIGHTS = {5: 0.97, 4: 0.9, 3: 0.8, 2: 0.6, 1: 0.4}


def _rules() -> dict[str, list[tuple[int, int, str, re.Pattern]]]:
    """keyword: (priority, order, label, pattern): the written rules, and for each family its name and identifier in the four
    ways in which licenses are stated."""
    rows: list[tuple[int, str, str, str]] = [(p, label, keys, rf"\b(?:{body})\b") for p, label, keys, body in RULE_LIST]
    for label, keys, name, ident in FAMILIES:
        rows += [
            (5, label, keys, rf"\bspdx license identifier (?:{ident})\b"),
            (4, label, keys, rf"\b(?:licen[sc]ed|released|distributed|published|available|provided) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{name})\b"),
            (3, label, keys, rf"\blicen[sc]es? (?:is |type )?(?:the )?(?:{ident})\b"),
            (2, label, keys, rf"\b(?:{name})\b"),
        ]
    out: dict[str, list] = {}
    for order, (priority, label, keys, pattern) in enumerate(rows):
        rule = (priority, order, label, re.compile(pattern))
        for key in keys.split():
            out.setdefault(key, []).append(rule)
    return out


RULES = _rules()
KEYWORDS = frozenset(RULES)


def unsuppressed(found: list[tuple[int, int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """(start, end, priority, label) of the hits (priority, order, start, end, label) that no stronger hit contains, by start.

    A hit is stronger by priority, then length, then order. What contains a suppressed hit's container contains the hit too,
    so it is enough to look at all hits, kept or not: a sweep by start for each priority, with the furthest end so far.
    """
    kept: list[tuple[int, int, int, str]] = []
    strong_starts: list[int] = []
    strong_reach: list[int] = []
    for priority in sorted({f[0] for f in found}, reverse=True):
        level = sorted(((f[2], -f[3], f[1], f[4]) for f in found if f[0] == priority))
        reach = -1
        for start, minus, _, label in level:
            at = bisect.bisect_right(strong_starts, start) - 1
            if reach < -minus and (at < 0 or strong_reach[at] < -minus):
                kept.append((start, -minus, priority, label))
            reach = max(reach, -minus)
        merged = sorted([*zip(strong_starts, strong_reach, strict=True), *((start, -minus) for start, minus, _, _ in level)])
        strong_starts, strong_reach = [x for x, _ in merged], list(itertools.accumulate((y for _, y in merged), max))
    return sorted(kept)


def detections(words: list[str], joined: str) -> list[tuple[int, int, int, str]]:
    """(start, end, priority, label) over ``joined``, kept ones only, by start; guards are left out."""
    hits = KEYWORDS.intersection(words)
    if not joined.isascii():  # signs beyond ASCII stay in words, but bound what a rule matches
        hits = hits.union(*(KEYWORDS.intersection(PLAIN.findall(w)) for w in set(words) if not w.isascii()))
    if not hits:
        return []
    found = [(priority, order, m.start(), m.end(), label) for priority, order, label, pattern in {r for k in hits for r in RULES[k]} for m in pattern.finditer(joined)]
    return [d for d in unsuppressed(found) if d[3]]


def scan(text: str) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, found of a text whose A-Z are lower case."""
    words = WORD.findall(text)
    joined = " ".join(words)
    padded = f" {joined} "
    at, base = [], set()
    for phrase, label in PHRASES.items():
        mark, i = f" {phrase} ", padded.find(f" {phrase} ")
        while i >= 0:
            at.append(i)
            base.add(label)
            i = padded.find(mark, i + 1)
    found = detections(words, joined)
    starts = np.cumsum([0, *(len(w) + 1 for w in words)]) if at or found else []  # of each word in joined
    number = lambda places: np.searchsorted(starts, places).tolist()
    miss = 0.5 ** len(base)
    for priority, _ in sorted({(p, label) for _, _, p, label in found}):
        miss *= 1 - WEIGHTS[priority]
    ends = number([e for _, e, _, _ in found]) if found else []
    spans = ",".join(f"{label}:{a}:{b}" for (_, _, _, label), a, b in zip(found, number([s for s, _, _, _ in found]) if found else [], ends, strict=True))
    at = number(at) if at else []
    return (
        len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)),
        ",".join(sorted(base | {x[3] for x in found})), 1 - miss, spans,
    )


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, found string"


def scan_licenses(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """A row for each row of ``df``: its id and the columns of ``RESULT``; ``found`` lists label:first word:end word."""
    names = [x.split()[0] for x in RESULT.split(", ")]

    def part(batch: pa.RecordBatch) -> dict:
        lower = pa.RecordBatch.from_arrays([pc.ascii_lower(batch.column("__t"))], ["t"])
        rows = [scan(t) for t in texts_of(lower, "t")]
        return {id_column: batch.column("__i")} | dict(zip(names, map(list, zip(*rows)), strict=True))

    kind = df.schema[id_column].dataType.simpleString()
    return arrow_map(df.selectExpr(f"`{id_column}` AS __i", f"`{text}` AS __t"), ["__i", "__t"], f"{id_column} {kind}, {RESULT}", part, "__t")


def op9_license_scan(spark, sf_dir) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
