"""License scan by ordered signature rules.

Each rule is a regular expression written by hand, with a label, a priority, a
confidence and keywords.  The words of a text say which rules' keywords it holds;
only those rules run, and a text with none of them meets no expression.  A name
behind a grant ("licensed under the terms of the ...") counts as stronger than the
name alone.  Detections are then resolved: one that lies inside the interval of
another of the same or a higher priority goes, and of two that overlap otherwise
the one of higher priority stays.

Rules meet a text in which line breaks, with the comment marks around them, and
other white space are one space; places are those of the text itself.  Tags are
read as whole SPDX expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import alnum_words, chunks, utf8

#: Phrases of the base and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

_V = r"(?:,? ?(?:version|v\.?) ?)"
#: label, keyword, expression for the licence's name, expression for its address or None.
_LICENSES = [
    ("agpl-3.0", "affero", rf"(?:gnu )?affero general public licen[sc]e{_V}? ?3(?:\.0)?", r"gnu\.org/licenses/agpl"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e", None),
    ("lgpl-3.0", "lesser", rf"(?:gnu )?lesser general public licen[sc]e{_V}? ?3(?:\.0)?", r"gnu\.org/licenses/lgpl-3"),
    ("lgpl-2.1", "lesser", rf"(?:gnu )?lesser general public licen[sc]e{_V}? ?2\.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-2.0", "library+general", rf"(?:gnu )?library general public licen[sc]e{_V}? ?2(?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]e", None),
    ("gpl-3.0", "general+public", rf"(?:gnu )?general public licen[sc]e{_V}? ?3(?:\.0)?", r"gnu\.org/licenses/gpl-3"),
    ("gpl-2.0", "general+public", rf"(?:gnu )?general public licen[sc]e{_V}? ?2(?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2"),
    ("gpl-1.0", "general+public", rf"(?:gnu )?general public licen[sc]e{_V}? ?1(?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1"),
    ("gfdl", "free+documentation", r"(?:gnu )?free documentation licen[sc]e", r"gnu\.org/(?:licenses|copyleft)/fdl"),
    ("apache-2.0", "apache", rf"apache (?:software )?licen[sc]e{_V}? ?2(?:\.0)?", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", "apache", rf"apache (?:software )?licen[sc]e{_V}? ?1\.1", r"apache\.org/licenses/license-1\.1"),
    ("apache-1.0", "apache", rf"apache (?:software )?licen[sc]e{_V}? ?1(?:\.0)?", r"apache\.org/licenses/license-1\.0"),
    ("mit", "mit", r"mit(?:/expat)? licen[sc]e", r"opensource\.org/licen[sc]es?/mit"),
    ("mit-0", "attribution", r"mit no attribution(?: licen[sc]e)?", r"opensource\.org/licen[sc]es?/mit-0"),
    ("x11", "x11", r"x11 licen[sc]e", None),
    ("isc", "isc", r"isc licen[sc]e", r"opensource\.org/licen[sc]es?/isc"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4[- ]clause|four[- ]clause bsd) licen[sc]e", r"spdx\.org/licenses/bsd-4-clause"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3[- ]clause|three[- ]clause bsd|3-clause bsd) licen[sc]e", r"opensource\.org/licen[sc]es?/bsd-3-clause"),
    ("bsd-2-clause", "freebsd", r"freebsd licen[sc]e", None),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2[- ]clause|two[- ]clause bsd|2-clause bsd) licen[sc]e", r"opensource\.org/licen[sc]es?/bsd-2-clause"),
    ("0bsd", "bsd|0bsd", r"(?:bsd zero clause|zero[- ]clause bsd|0bsd) licen[sc]e", r"opensource\.org/licen[sc]es?/0bsd"),
    ("bsd", "bsd", r"bsd(?:-style)? licen[sc]e", r"opensource\.org/licen[sc]es?/bsd-license"),
    ("mpl-2.0", "mozilla", rf"mozilla public licen[sc]e{_V}? ?2(?:\.0)?", r"mozilla\.org/mpl/2\.0"),
    ("mpl-1.1", "mozilla", rf"mozilla public licen[sc]e{_V}? ?1\.1", r"mozilla\.org/mpl/1\.1"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", r"mozilla\.org/mpl"),
    ("epl-2.0", "eclipse", rf"eclipse public licen[sc]e{_V}?(?: -)? ?v? ?2(?:\.0)?", r"eclipse\.org/legal/epl-2\.0|eclipse\.org/legal/epl-v20"),
    ("epl-1.0", "eclipse", rf"eclipse public licen[sc]e{_V}?(?: -)? ?v? ?1(?:\.0)?", r"eclipse\.org/legal/epl-v10"),
    ("cddl-1.0", "common+distribution", r"common development and distribution licen[sc]e", r"opensource\.org/licen[sc]es?/cddl"),
    ("cpl-1.0", "common+public", r"common public licen[sc]e", r"opensource\.org/licen[sc]es?/cpl"),
    ("artistic-2.0", "artistic", rf"artistic licen[sc]e{_V}? ?2(?:\.0)?", r"opensource\.org/licen[sc]es?/artistic-2\.0"),
    ("artistic-1.0", "artistic", r"artistic licen[sc]e", r"opensource\.org/licen[sc]es?/artistic-1\.0"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e", r"boost\.org/license_1_0"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[sc]e", r"opensource\.org/licen[sc]es?/zlib"),
    ("unlicense", "unlicense|unlicence", r"(?:the |an )unlicen[sc]e", r"unlicense\.org"),
    ("wtfpl", "want+public", r"do what the f.{1,3}k you want to public licen[sc]e", r"wtfpl\.net"),
    ("psf-2.0", "python", r"python software foundation licen[sc]e", r"docs\.python\.org/[0-9.]+/license"),
    ("php-3.01", "php", r"php licen[sc]e", r"php\.net/license"),
    ("ruby", "ruby", r"ruby licen[sc]e", None),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", r"opensource\.org/licen[sc]es?/postgresql"),
    ("openssl", "openssl", r"openssl licen[sc]e", r"openssl\.org/source/license"),
    ("ofl-1.1", "open+font", r"(?:sil )?open font licen[sc]e", r"scripts\.sil\.org/ofl"),
    ("odbl-1.0", "open+database", r"open database licen[sc]e", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", "commons+attribution", r"open data commons attribution licen[sc]e", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", "public+domain", r"public domain dedication (?:and|&) licen[sc]e", r"opendatacommons\.org/licenses/pddl"),
    ("ecl-2.0", "educational", r"educational community licen[sc]e", r"opensource\.org/licen[sc]es?/ecl"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", r"opensource\.org/licen[sc]es?/ms-pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", r"opensource\.org/licen[sc]es?/ms-rl"),
    ("eupl-1.2", "european+union", r"european union public licen[sc]e", r"eupl\.eu|joinup\.ec\.europa\.eu"),
    ("afl-3.0", "academic", r"academic free licen[sc]e", r"opensource\.org/licen[sc]es?/afl"),
    ("osl-3.0", "open+software", r"open software licen[sc]e", r"opensource\.org/licen[sc]es?/osl"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa open source licen[sc]e", r"opensource\.org/licen[sc]es?/ncsa"),
    ("upl-1.0", "universal+permissive", r"universal permissive licen[sc]e", r"opensource\.org/licen[sc]es?/upl"),
    ("cecill-2.1", "cecill", r"cecill(?:-[bc])?(?: free software)? licen[sc]e", r"cecill\.info"),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e", r"elastic\.co/licensing/elastic-license"),
    ("sspl-1.0", "server+side", r"server side public licen[sc]e", r"mongodb\.com/licensing/server-side"),
    ("busl-1.1", "business+source", r"business source licen[sc]e", r"mariadb\.com/bsl11"),
    ("public-domain", "public+domain", r"(?:released|placed|dedicated) (?:in)?to the public domain", None),
]
#: What stands between a short name and its version; a version ends where its number does.
_TO = r"(?:[- ,]*v(?:ersion)?[. ]*|[- ])?"
_END = r"(?!\.?\d)"
#: Names with a version in front of, between or behind a short name: label, keywords, expression; {v} is the version found, .0 if it has no part.
_FORMS = [
    ("agpl-{v}", "affero", rf"(?:version|v\.?) ?(?P<v>3(?:\.0)?){_END} of the (?:gnu )?affero general public licen[sc]e"),
    ("lgpl-{v}", "lesser|library", rf"(?:version|v\.?) ?(?P<v>2\.1|[23](?:\.0)?){_END} of the (?:gnu )?(?:lesser|library) general public licen[sc]e"),
    ("gpl-{v}", "general+public", rf"(?:version|v\.?) ?(?P<v>[123](?:\.0)?){_END} of the (?:gnu )?general public licen[sc]e"),
    ("apache-{v}", "apache", rf"(?:version|v\.?) ?(?P<v>1\.1|[12](?:\.0)?){_END} of the apache (?:software )?licen[sc]e"),
    ("mpl-{v}", "mozilla", rf"(?:version|v\.?) ?(?P<v>1\.1|2(?:\.0)?){_END} of the mozilla public licen[sc]e"),
    ("epl-{v}", "eclipse", rf"(?:version|v\.?) ?(?P<v>[12](?:\.0)?){_END} of the eclipse public licen[sc]e"),
    ("agpl-{v}", "affero", rf"(?:gnu )?affero general public licen[sc]e as published by the free software foundation[,;:]? (?:either )?version (?P<v>3(?:\.0)?){_END}"),
    ("lgpl-{v}", "lesser|library", rf"(?:gnu )?(?:lesser|library) general public licen[sc]e as published by the free software foundation[,;:]? (?:either )?version (?P<v>2\.1|[23](?:\.0)?){_END}"),
    ("gpl-{v}", "general+public", rf"(?:gnu )?general public licen[sc]e as published by the free software foundation[,;:]? (?:either )?version (?P<v>[123](?:\.0)?){_END}"),
    ("agpl-{v}", "agpl|agplv3|agpl3", rf"(?:gnu )?agpl{_TO}(?P<v>3(?:\.0)?){_END}(?: licen[sc]e)?"),
    ("lgpl-{v}", "lgpl|lgplv2|lgplv3|lgpl2|lgpl3", rf"(?:gnu )?lgpl{_TO}(?P<v>2\.1|[23](?:\.0)?){_END}(?: licen[sc]e)?"),
    ("gpl-{v}", "gpl|gplv1|gplv2|gplv3|gpl1|gpl2|gpl3", rf"(?:gnu )?gpl{_TO}(?P<v>[123](?:\.0)?){_END}(?: licen[sc]e)?"),
    ("apache-{v}", "asl|aslv2|asl2", rf"asl{_TO}(?P<v>1\.1|[12](?:\.0)?){_END}(?: licen[sc]e)?"),
    ("mpl-{v}", "mpl|mplv2|mplv1|mpl2|mpl1", rf"mpl{_TO}(?P<v>1\.1|2(?:\.0)?){_END}(?: licen[sc]e)?"),
    ("epl-{v}", "epl|eplv1|eplv2|epl1|epl2", rf"epl{_TO}(?P<v>[12](?:\.0)?){_END}(?: licen[sc]e)?"),
    ("apache-{v}", "apache", rf"apache(?: software)?{_TO}(?P<v>1\.1|[12](?:\.0)?){_END} (?:software )?licen[sc]e"),
    ("agpl", "agpl", r"(?:gnu )?agpl licen[sc]e"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl licen[sc]e"),
    ("gpl", "gpl", r"(?:gnu )?gpl licen[sc]e"),
    ("bsd-4-clause", "clause", r"(?:bsd[- ](?:4|four)[- ]clause|(?:4|four)[- ]clause[- ]bsd)(?: licen[sc]e)?"),
    ("bsd-3-clause", "clause", r"(?:bsd[- ](?:3|three)[- ]clause|(?:3|three)[- ]clause[- ]bsd)(?: licen[sc]e)?"),
    ("bsd-2-clause", "clause", r"(?:bsd[- ](?:2|two)[- ]clause|(?:2|two)[- ]clause[- ]bsd)(?: licen[sc]e)?"),
    ("0bsd", "0bsd", r"0bsd"),
]
_MARK = r"(?P<m>by(?:[- ]nc)?(?:[- ](?:sa|nd))?)"
#: Creative Commons marks: priority, confidence, label, keywords, expression; {m} is the mark found.
_CC = [
    (4, 0.95, "cc-{m}-{v}", "cc", rf"\bcc[- ]{_MARK}[- ](?P<v>[1-4]\.\d)(?!\w)"),
    (3, 0.9, "cc-{m}-{v}", "creativecommons", r"creativecommons\.org/licenses/(?P<m>by(?:-nc)?(?:-(?:sa|nd))?)/(?P<v>[1-4]\.\d)"),
    (2, 0.7, "cc-{m}", "cc", rf"\bcc[- ]{_MARK}(?![\w-])"),
    (4, 0.95, "cc-by-nc-sa{w}", "creative+commons", r"creative commons attribution[- ]non-?commercial[- ]share ?-?alike(?P<w> [1-4]\.\d)?(?: international| unported| generic)?(?: licen[sc]e)?"),
    (4, 0.95, "cc-by-nc-nd{w}", "creative+commons", r"creative commons attribution[- ]non-?commercial[- ]no ?-?deriv(?:ative)?s?(?: works)?(?P<w> [1-4]\.\d)?(?: international| unported| generic)?(?: licen[sc]e)?"),
    (4, 0.95, "cc-by-nc{w}", "creative+commons", r"creative commons attribution[- ]non-?commercial(?P<w> [1-4]\.\d)?(?: international| unported| generic)?(?: licen[sc]e)?"),
    (4, 0.95, "cc-by-sa{w}", "creative+commons", r"creative commons attribution[- ]share ?-?alike(?P<w> [1-4]\.\d)?(?: international| unported| generic)?(?: licen[sc]e)?"),
    (4, 0.95, "cc-by-nd{w}", "creative+commons", r"creative commons attribution[- ]no ?-?deriv(?:ative)?s?(?: works)?(?P<w> [1-4]\.\d)?(?: international| unported| generic)?(?: licen[sc]e)?"),
    (4, 0.95, "cc-by{w}", "creative+commons", r"creative commons attribution(?P<w> [1-4]\.\d)?(?: international| unported| generic)?(?: licen[sc]e)?"),
    (4, 0.95, "cc0-1.0", "cc0", r"\bcc0(?:[- ]1\.0)?(?: universal)?\b"),
    (3, 0.9, "cc0-1.0", "creativecommons", r"creativecommons\.org/publicdomain/zero/1\.0"),
    (2, 0.8, "cc0-1.0", "waived+copyright", r"waived all copyright and related or neighbou?ring rights"),
]
#: Sentences of licences and notices: priority, confidence, label, keywords, expression.
_NOTICES = [
    (3, 0.9, "mit", "hereby+charge", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (3, 0.85, "mit", "substantial+portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    (3, 0.9, "isc", "modify+distribute+fee", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    (3, 0.9, "0bsd", "modify+distribute+fee", r"permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee is hereby granted\.(?! provided)"),
    (3, 0.85, "bsd", "redistribution+binary", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    (3, 0.9, "bsd-3-clause", "endorse+promote", r"neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products"),
    (3, 0.9, "bsd-4-clause", "advertising+acknowledgement", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    (2, 0.7, "bsd", "redistributions+retain", r"redistributions of source code must retain the above copyright notice"),
    (3, 0.9, "x11", "consortium", r"except as contained in this notice, the name of the x consortium shall not be used"),
    (3, 0.9, "zlib", "origin+misrepresented", r"the origin of this software must not be misrepresented"),
    (2, 0.7, "zlib", "altered+source", r"altered source versions must be plainly marked as such"),
    (3, 0.9, "bsl-1.0", "machine+executable", r"machine-executable object code generated by a source language processor"),
    (3, 0.9, "unlicense", "encumbered", r"this is free and unencumbered software released into the public domain"),
    (3, 0.9, "unlicense", "unencumbered", r"free and unencumbered software released into the public domain"),
    (3, 0.9, "wtfpl", "want", r"you just do what the f.{1,3}k you want to"),
    (3, 0.9, "apache-2.0", "limitations+governing", r"see the license for the specific language governing permissions and limitations under the license"),
    (2, 0.7, "apache-2.0", "perpetual+royalty", r"perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (?:copyright|patent) license to reproduce, prepare derivative works of"),
    (3, 0.9, "apache-1.1", "apache+acknowledgment", r"this product includes software developed by the apache software foundation"),
    (3, 0.85, "gpl", "redistribute+general", r"this program is free software[:;,]? you can redistribute it and/or modify it under the terms of the gnu general public licen[sc]e"),
    (3, 0.85, "lgpl", "redistribute+lesser", r"this library is free software[:;,]? you can redistribute it and/or modify it under the terms of the gnu lesser general public licen[sc]e"),
    (3, 0.85, "agpl", "redistribute+affero", r"this program is free software[:;,]? you can redistribute it and/or modify it under the terms of the gnu affero general public licen[sc]e"),
    (2, 0.7, "gpl", "received+general", r"you should have received a copy of the gnu general public licen[sc]e"),
    (2, 0.7, "lgpl", "received+lesser", r"you should have received a copy of the gnu lesser general public licen[sc]e"),
    (2, 0.7, "agpl", "received+affero", r"you should have received a copy of the gnu affero general public licen[sc]e"),
    (2, 0.7, "agpl", "remotely+network", r"if your software can interact with users remotely through a computer network"),
    (2, 0.6, "gpl", "copyleft+gnu", r"gnu(?:'s)? copyleft"),
    (3, 0.85, "gfdl", "invariant+sections", r"with no invariant sections, no front-cover texts,? and no back-cover texts"),
    (3, 0.9, "mpl-2.0", "mozilla+source", r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0"),
    (3, 0.9, "mpl-1.1", "contents+mozilla", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    (2, 0.7, "mpl-2.0", "incompatible+secondary", r"incompatible with secondary licenses"),
    (3, 0.9, "epl-2.0", "accompanying+eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v\.? ?)?2\.0"),
    (3, 0.9, "epl-1.0", "accompanying+eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1\.0"),
    (3, 0.9, "cddl-1.0", "cddl", r"subject to the terms of the common development and distribution license"),
    (2, 0.8, "cddl-1.0", "cddl", r"\bcddl[- ]1\.0\b"),
    (2, 0.8, "cddl-1.1", "cddl", r"\bcddl[- ]1\.1\b"),
    (3, 0.85, "artistic-1.0", "perl+itself", r"under the same terms as perl itself"),
    (3, 0.85, "psf-2.0", "python+psf", r"psf is making python available to licensee on an \"?as is\"? basis"),
    (3, 0.85, "php-3.01", "php+group", r"this product includes php software, freely available from"),
    (3, 0.9, "openssl", "openssl+project", r"this product includes software developed by the openssl project"),
    (2, 0.8, "ssleay", "eric+cryptographic", r"this product includes cryptographic software written by eric young"),
    (3, 0.9, "ofl-1.1", "reserved+font", r"with reserved font name"),
    (2, 0.8, "ofl-1.1", "ofl", r"\bsil ofl(?:[- ]1\.1)?\b"),
    (3, 0.9, "odbl-1.0", "odbl", r"\bodbl(?:[- ]1\.0)?\b"),
    (3, 0.9, "openstreetmap", "openstreetmap", r"(?:©|\(c\)|copyright) openstreetmap contributors"),
    (2, 0.8, "pddl-1.0", "pddl", r"\bpddl(?:[- ]1\.0)?\b"),
    (3, 0.85, "ms-pl", "microsoft+permissive", r"microsoft permissive licen[sc]e"),
    (2, 0.8, "ms-pl", "ms+pl", r"\bms-pl\b"),
    (2, 0.8, "ms-rl", "ms+rl", r"\bms-rl\b"),
    (2, 0.8, "eupl-1.2", "eupl", r"\beupl[ -]?(?:v\.? ?)?1\.2\b"),
    (2, 0.8, "eupl-1.1", "eupl", r"\beupl[ -]?(?:v\.? ?)?1\.1\b"),
    (2, 0.8, "afl-3.0", "afl", r"\bafl[ -]?(?:v\.? ?)?3\.0\b"),
    (2, 0.8, "osl-3.0", "osl", r"\bosl[ -]?(?:v\.? ?)?3\.0\b"),
    (3, 0.85, "ncsa", "illinois+deal", r"developed by:? .{1,80}? university of illinois"),
    (2, 0.8, "upl-1.0", "upl", r"\bupl[ -]1\.0\b"),
    (3, 0.85, "cecill-2.1", "cecill", r"(?:governed by|soumis à|régi par) (?:the |la licence )?cecill"),
    (3, 0.9, "sspl-1.0", "sspl", r"\bsspl(?:[- ]?v?1(?:\.0)?)?\b"),
    (3, 0.9, "busl-1.1", "change+busl", r"\bbusl[- ]1\.1\b"),
    (2, 0.7, "busl-1.1", "additional+grant", r"additional use grant"),
    (3, 0.9, "elastic-2.0", "elastic+hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    (3, 0.9, "commons-clause", "clause+sell", r"commons clause"),
    (3, 0.9, "json", "good+evil", r"the software shall be used for good, not evil"),
    (3, 0.9, "beerware", "beer", r"you can buy me a beer in return"),
    (2, 0.8, "beerware", "beerware", r"\bbeer-?ware licen[sc]e"),
    (3, 0.85, "curl", "curl+stenberg", r"copyright \(c\) .{1,40}? daniel stenberg"),
    (3, 0.85, "icu", "icu+ibm", r"icu licen[sc]e"),
    (3, 0.85, "unicode", "unicode+data", r"unicode(?:, inc\.)? (?:data files|licen[sc]e agreement)"),
    (2, 0.8, "libpng", "png+reference", r"png reference library licen[sc]e"),
    (2, 0.8, "libtiff", "sam+leffler", r"copyright \(c\) .{1,30}? sam leffler"),
    (2, 0.8, "ijg", "independent+jpeg", r"independent jpeg group(?:'s)? (?:free )?(?:jpeg )?software"),
    (2, 0.8, "tcl", "tcl", r"tcl(?:/tk)? licen[sc]e"),
    (2, 0.8, "vim", "vim", r"vim licen[sc]e"),
    (2, 0.8, "w3c", "w3c", r"w3c(?:®)? (?:software (?:and document )?)?(?:notice and )?licen[sc]e"),
    (2, 0.8, "ntp", "ntp", r"ntp licen[sc]e"),
    (2, 0.8, "hpnd", "historical+permission", r"historical permission notice and disclaimer"),
    (2, 0.8, "mulanpsl-2.0", "mulan", r"mulan psl v ?2|mulan permissive software licen[sc]e,? version 2"),
    (2, 0.8, "blueoak-1.0.0", "oak", r"blue oak model licen[sc]e(?: 1\.0\.0)?"),
    (2, 0.8, "hippocratic", "hippocratic", r"hippocratic licen[sc]e"),
    (2, 0.8, "polyform-noncommercial", "polyform", r"polyform noncommercial licen[sc]e"),
    (2, 0.8, "polyform-small-business", "polyform", r"polyform small business licen[sc]e"),
    (2, 0.8, "openrail", "openrail", r"\b(?:creativeml |bigscience |bigcode )?open ?rail(?:-?[ms])?(?:\+\+)?(?: licen[sc]e)?"),
    (2, 0.8, "rail", "rail+responsible", r"responsible ai licen[sc]e"),
    (2, 0.8, "cdla-permissive", "cdla|community+data", r"\bcdla-permissive-[12]\.0\b|community data licen[sc]e agreement[- –]+permissive"),
    (2, 0.8, "cdla-sharing", "cdla|community+data", r"\bcdla-sharing-1\.0\b|community data licen[sc]e agreement[- –]+sharing"),
    (2, 0.8, "etalab-2.0", "etalab", r"(?:licence ouverte|open licence)[ /]*(?:etalab)?|etalab[- ]2\.0"),
    (2, 0.8, "ogl-uk-3.0", "government+open", r"open government licen[sc]e(?: v?3(?:\.0)?)?"),
    (2, 0.8, "dl-de-by-2.0", "datenlizenz", r"datenlizenz deutschland[ –-]+namensnennung"),
    (2, 0.8, "gpl-3.0-font", "font+exception", r"gpl font exception"),
    (2, 0.8, "classpath-exception", "classpath", r"classpath exception"),
    (2, 0.7, "llvm-exception", "llvm+exceptions|llvm+exception", r"llvm exceptions?"),
    (2, 0.7, "gcc-exception", "gcc+runtime", r"gcc runtime library exception"),
    (2, 0.8, "dual-licensed", "dual|dually", r"\bdual(?:ly)?[- ]licen[sc]ed\b"),
    (2, 0.7, "freeware", "freeware", r"\bthis (?:software|program|file) is freeware\b"),
    (2, 0.7, "shareware", "shareware", r"\bthis (?:software|program) is shareware\b"),
    (2, 0.8, "public-domain", "public+domain", r"\b(?:is|are) in the public domain\b"),
    (2, 0.8, "public-domain", "public+domain", r"\bpublic domain mark\b"),
    (2, 0.8, "public-domain", "gutenberg", r"project gutenberg(?:-tm|™)? licen[sc]e"),
    (2, 0.8, "us-government-work", "government+works", r"works? of the (?:united states|u\.s\.) government"),
    (1, 0.6, "proprietary", "rights", r"\ball rights reserved\b"),
    (1, 0.6, "proprietary", "derechos", r"\btodos los derechos reservados\b"),
    (1, 0.6, "proprietary", "rechte", r"\balle rechte vorbehalten\b"),
    (1, 0.6, "proprietary", "droits", r"\btous droits réservés\b"),
    (1, 0.7, "proprietary", "permission", r"\bmay not be (?:copied|reproduced|redistributed|published|broadcast|rewritten)(?:,? (?:or )?(?:copied|reproduced|redistributed|published|broadcast|rewritten))* without (?:the )?(?:prior |express )?(?:written )?(?:permission|consent)\b"),
    (1, 0.7, "proprietary", "reproduction+prohibited", r"\b(?:unauthorized )?reproduction (?:in whole or in part )?(?:without (?:written )?permission )?is (?:strictly )?prohibited\b"),
    (1, 0.7, "proprietary", "confidential", r"\bproprietary and confidential\b|\bconfidential and proprietary\b"),
    (1, 0.7, "proprietary", "eula|agreement", r"\bend[- ]user licen[sc]e agreement\b"),
    (1, 0.7, "proprietary", "trade+secret|trade+secrets", r"\bcontains? (?:valuable )?trade secrets?\b"),
    (1, 0.7, "no-ai-training", "training+machine|training+ai", r"\bmay not be used (?:to|for) train(?:ing)? (?:of )?(?:any )?(?:ai|machine learning|artificial intelligence)"),
    (1, 0.7, "non-commercial", "commercial|noncommercial", r"\bfor non-?commercial use only\b|\bpersonal,? non-?commercial use\b"),
    (1, 0.7, "research-only", "research", r"\bfor (?:academic|research)(?: and (?:academic|research))? (?:use|purposes) only\b"),
]
_GRANT = r"(?P<grant>(?:licen[sc]ed|released|distributed|published|available|provided|redistributed) under (?:the )?(?:terms of )?(?:the |an? )?)?"


@dataclass(frozen=True)
class Rule:
    """A signature: ``keywords`` are words joined by +, alternatives by |; {v}, {w} and {m} in the label stand for what the expression's groups find."""

    label: str
    keywords: str
    pattern: str
    priority: int
    confidence: float


def rules() -> list[Rule]:
    """All rules, the strongest first: marks, addresses, sentences, names, notices; a name behind a grant is raised in ``Scanner``."""
    out = []
    for label, keywords, name, address in _LICENSES:
        out.append(Rule(label, keywords, rf"\b{_GRANT}(?:{name})(?![\w])", 2, 0.8))
        if address:
            hosts = "|".join(re.match(r"[\w-]+", a.replace("\\", ""))[0] for a in address.split("|"))
            out.append(Rule(label, hosts.replace("-", "+"), rf"https?://(?:www\.)?(?:{address})", 3, 0.9))
    out += [Rule(label, keywords, rf"\b{_GRANT}(?:{name})(?![\w])", 2, 0.8) for label, keywords, name in _FORMS]
    out += [Rule(label, keywords, pattern, priority, confidence) for priority, confidence, label, keywords, pattern in [*_CC, *_NOTICES]]
    return sorted(out, key=lambda r: -r.priority)


#: Labels that a tag may name; versions and marks of Creative Commons follow by rule.
_TAGGED = {r.label for r in rules() if "{" not in r.label} | {f"{stem}-{v}" for stem, vs in {"agpl": ["3.0"], "lgpl": ["2.0", "2.1", "3.0"], "gpl": ["1.0", "2.0", "3.0"], "cddl": ["1.0", "1.1"]}.items() for v in vs}
_TAGGED_CC = re.compile(r"cc-by(?:-nc)?(?:-(?:sa|nd))?-[1-4]\.\d")
_SUFFIX = re.compile(r"(?:-only|-or-later|\+)$")


_MARKS = r"[#*/;%!>|]"
#: White space; around a line break also comment marks. It gives nothing back, so a miss costs no second try.
GAP = rf"(?>(?:[^\S\n]+{_MARKS}+)?\s*\n\s*(?:(?:{_MARKS}+|--+(?=\s)|(?:dnl|rem)(?=\s))\s*)*|\s+)"
_GAP = re.compile(GAP)
_TAG = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*(?=[\w(])")
_OPERAND = re.compile(rf"((?:\({GAP}?)*)([a-z0-9](?:[a-z0-9.:-]*[a-z0-9])?\+?)")
_OPERATOR = [re.compile(rf"((?:{gap}?\))*)(?:{gap}|(?<=\)))(?:and|or|with)\b{GAP}?") for gap in (r"[ \t]+", GAP)]


def folded(text: str) -> tuple[str, list[int], list[int]]:
    """A text with each gap as one space; and where in it and in the text pieces start that have no gap but single spaces."""
    parts, here, there, size, last = [], [0], [0], 0, 0
    for m in _GAP.finditer(text):
        if m.group() == " ":
            continue
        parts += [text[last : m.start()], " "]
        size += m.start() - last + 1
        last = m.end()
        here.append(size)
        there.append(last)
    return ("".join([*parts, text[last:]]) if parts else text), here, there


def spdx_ids(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and id of each operand of the SPDX expressions of a text; the first starts with its tag.

    An expression goes on in the next line behind an operator and within parentheses.
    """
    for tag in _TAG.finditer(text):
        start, at, depth = tag.start(), tag.end(), 0
        while operand := _OPERAND.match(text, at):
            depth += operand[1].count("(")
            yield (operand.start(2) if start is None else start), operand.end(), operand[2]
            operator = _OPERATOR[depth > 0].match(text, operand.end())
            if not operator:
                break
            depth -= operator[1].count(")")
            start, at = None, operator.end()


class Scanner:
    """All rules, compiled, behind their keywords."""

    def __init__(self, own: list[Rule] | None = None):
        self.rules = [(r, re.compile(r.pattern)) for r in (rules() if own is None else own)]
        self.by_word: dict[str, list[tuple[frozenset[str], int]]] = {}
        for k, (rule, _) in enumerate(self.rules):
            for every in rule.keywords.split("|"):
                words = every.split("+")
                self.by_word.setdefault(max(words, key=len), []).append((frozenset(words), k))
        self.gate = frozenset([*self.by_word, "spdx"])

    def detect(self, text: str, words: set[str] | None = None) -> list[tuple[int, int, str, float]]:
        """Start, end, label and confidence of what is left after suppression; text with A-Z lower-cased, its words of letters and digits."""
        if words is None:
            words = {w.decode("utf-8", "replace") for w in alnum_words(text.encode("utf-8", "surrogatepass"))}
        met = words & self.gate
        if not met:
            return []
        flat, here, there = folded(text)

        def place(at: int) -> int:
            k = bisect_right(here, at) - 1
            return there[k] + at - here[k]

        found = []
        for k in sorted({k for word in met & self.by_word.keys() for every, k in self.by_word[word] if every <= words}):
            rule, pattern = self.rules[k]
            for m in pattern.finditer(flat):
                if m.end() > m.start():
                    a, b, own = place(m.start()), place(m.end() - 1) + 1, m.groupdict()
                    granted = own.get("grant")
                    label = _label(rule.label, own) if "{" in rule.label else rule.label
                    found.append((-4 if granted else -rule.priority, a - b, a, k, b, label, 0.95 if granted else rule.confidence))
        if "spdx" in words:
            for a, b, name in spdx_ids(text):
                label = _SUFFIX.sub("", name)
                if label in _TAGGED or _TAGGED_CC.fullmatch(label):
                    found.append((-5, a - b, a, -1, b, label, 1.0))
        starts: list[int] = []
        kept: list[tuple[int, int, str, float]] = []  # in order; they don't overlap, so only neighbours can meet a further one
        for _, _, start, _, end, label, confidence in sorted(found):  # higher priority, then longer, then further left, then earlier rule
            at = bisect_right(starts, start)
            if (at and kept[at - 1][1] > start) or (at < len(kept) and kept[at][0] < end):
                continue
            starts.insert(at, start)
            kept.insert(at, (start, end, label, confidence))
        return kept


def _label(form: str, found: dict) -> str:
    """A rule's label with the version and mark that were found."""
    version, mark, rest = found.get("v") or "", (found.get("m") or "").replace(" ", "-"), (found.get("w") or "").strip()
    return form.format(v=version if "." in version else f"{version}.0", m=mark, w=f"-{rest}" if rest else "")


def phrase_places(words: list[bytes], phrases=PHRASES) -> list[tuple[int, str]]:
    """Word numbers at which a phrase's words stand, and its label."""
    line = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases:
        sought = f" {phrase} ".encode()
        at, number, upto = line.find(sought), 0, 0
        while at >= 0:
            number += line.count(b" ", upto, at)
            out.append((number, label))
            upto, at = at, line.find(sought, at + 1)
    return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases=PHRASES, own_rules: list[Rule] | None = None) -> DataFrame:
    """Licence statements in each whole text.

    docs: any frame with an id and a text; other columns are ignored.  A-Z count as
    lower case.  Base: places where the words of a phrase stand one after another,
    in words of letters, digits and non-ASCII characters.
    Returns doc_id, n_words, n_base (places), first_word and last_word (their
    smallest and largest start, null without any), base_labels and labels (comma
    lists, sorted; labels also has those of the rules), score (the highest
    confidence, 1 for a phrase, else 0), detections (start, end, label,
    confidence; in characters).  Null and empty texts have none; rows that share an
    id or have none keep their own rows; an empty table gives an empty table.
    """
    out = "doc_id {0}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:int,end:int,label:string,confidence:double>>"
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def scanned(batches):
        scanner = Scanner(own_rules)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in chunks(offsets):
                raw, own = data[offsets[i] : offsets[j]].tobytes(), offsets[i : j + 1] - offsets[i]
                rows = []
                for k in range(j - i):
                    piece = raw[own[k] : own[k + 1]]
                    words = alnum_words(piece)
                    places = phrase_places(words, phrases)
                    lower = piece.lower().decode("utf-8", "replace")
                    found = scanner.detect(lower, {w.decode("utf-8", "replace") for w in set(words) if len(w) <= 32} if words else set())
                    base = sorted({x for _, x in places})
                    starts = [x for x, _ in places]
                    rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *(x[2] for x in found)})), 1.0 if places else max((x[3] for x in found), default=0.0), [dict(zip(("start", "end", "label", "confidence"), x)) for x in found]))
                columns = list(zip(*rows))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("confidence", pa.float64())]))]
                names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *[pa.array(c, t) for c, t in zip(columns, kinds)]], ["doc_id", *names])

    return rows.mapInArrow(scanned, out.format(rows.schema["doc_id"].dataType.simpleString()))
