"""License scans by ordered signature rules.

A keyword prefilter sends only texts with a licensing word on to the rules. Their text becomes a
line of lower-case words; each rule whose own keyword occurs matches its regular expression on it
and gives intervals of words. Detections are taken from left to right, longer ones first: one that
lies within another is suppressed, and of two that overlap in part the one of higher priority
stays. Rules of notices come before identifiers, and these before mere names.
Everything is DataFrame expressions on the row itself; nothing is shuffled.

Rows: a null text counts as empty: no words, no labels (empty strings), score 0, null places;
every row, repeated or with a null id, gives one row; other columns are ignored. Of detections with the
same words the one of higher priority counts, then the label first in order. A text of any length is read
whole, at a cost linear in its words and detections of a rule.
"""

from __future__ import annotations

from collections.abc import Callable
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonaria.llm.common import table
from sonaria.llm.multiset import let

WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]++"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases of consecutive words and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

V = r"(?: v(?:ersion)?)?"
OR_LATER = r"(?: or (?:any )?later(?: version)?| only)?"
#: label: (keyword, expression of the licence's name on lower-case words, its SPDX words)
NAMES = {
    "apache-2.0": ("apache", rf"apache(?: software)? licen[sc]e{V} 2(?: 0)?", "apache 2 0"),
    "apache-1.1": ("apache", rf"apache(?: software)? licen[sc]e{V} 1 1", "apache 1 1"),
    "apache": ("apache", r"apache(?: software)? licen[sc]e", "apache"),
    "mit": ("mit", r"mit(?: x11)?(?: licen[sc]e)?", "mit"),
    "x11": ("x11", r"x11 licen[sc]e", "x11"),
    "isc": ("isc", r"isc licen[sc]e", "isc"),
    "bsd-2-clause": ("bsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?", "bsd 2 clause"),
    "bsd-3-clause": ("bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd)(?: licen[sc]e)?", "bsd 3 clause"),
    "bsd-4-clause": ("bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[sc]e)?", "bsd 4 clause"),
    "0bsd": ("bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)(?: licen[sc]e)?", "0bsd"),
    "bsd": ("bsd", r"bsd(?: style)? licen[sc]e", "bsd"),
    "agpl-3.0": ("affero", rf"(?:gnu )?affero general public licen[sc]e{V} 3(?: 0)?{OR_LATER}", "agpl 3 0"),
    "agpl": ("affero", r"(?:gnu )?affero general public licen[sc]e", "agpl"),
    "lgpl-2.1": ("lesser", rf"(?:gnu )?lesser general public licen[sc]e{V} 2 1{OR_LATER}", "lgpl 2 1"),
    "lgpl-3.0": ("lesser", rf"(?:gnu )?lesser general public licen[sc]e{V} 3(?: 0)?{OR_LATER}", "lgpl 3 0"),
    "lgpl-2.0": ("library", rf"(?:gnu )?library general public licen[sc]e{V} 2(?: 0)?{OR_LATER}", "lgpl 2 0"),
    "lgpl": ("general", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", "lgpl"),
    "gpl-1.0": ("general", rf"(?:gnu )?general public licen[sc]e{V} 1(?: 0)?{OR_LATER}", "gpl 1 0"),
    "gpl-2.0": ("general", rf"(?:gnu )?general public licen[sc]e{V} 2(?: 0)?{OR_LATER}", "gpl 2 0"),
    "gpl-3.0": ("general", rf"(?:gnu )?general public licen[sc]e{V} 3(?: 0)?{OR_LATER}", "gpl 3 0"),
    "gpl": ("general", r"(?:gnu )?general public licen[sc]e", "gpl"),
    "gpl-short": ("gpl", rf"(?:gnu )?gpl(?:{V} ?v?[123](?: 0)?)?{OR_LATER}", "gpl"),
    "lgpl-short": ("lgpl", rf"(?:gnu )?lgpl(?:{V} ?v?[23](?: [01])?)?{OR_LATER}", "lgpl"),
    "fdl": ("documentation", r"(?:gnu )?free documentation licen[sc]e", "gfdl 1 3"),
    "mpl-1.1": ("mozilla", rf"mozilla public licen[sc]e{V} 1 1", "mpl 1 1"),
    "mpl-2.0": ("mozilla", rf"mozilla public licen[sc]e{V} 2(?: 0)?", "mpl 2 0"),
    "mpl": ("mozilla", r"mozilla public licen[sc]e", "mpl"),
    "epl-1.0": ("eclipse", rf"eclipse public licen[sc]e{V} 1 0", "epl 1 0"),
    "epl-2.0": ("eclipse", rf"eclipse public licen[sc]e{V} 2 0", "epl 2 0"),
    "epl": ("eclipse", r"eclipse public licen[sc]e", "epl"),
    "edl": ("eclipse", r"eclipse distribution licen[sc]e", "edl 1 0"),
    "eupl": ("european", r"european union public licen[sc]e", "eupl 1 2"),
    "cddl": ("common", r"common development and distribution licen[sc]e", "cddl 1 0"),
    "cpl": ("common", r"common public licen[sc]e", "cpl 1 0"),
    "ms-pl": ("microsoft", r"microsoft public licen[sc]e", "ms pl"),
    "ms-rl": ("microsoft", r"microsoft reciprocal licen[sc]e", "ms rl"),
    "artistic-1.0": ("artistic", rf"artistic licen[sc]e{V} 1(?: 0)?", "artistic 1 0"),
    "artistic-2.0": ("artistic", rf"artistic licen[sc]e{V} 2(?: 0)?", "artistic 2 0"),
    "artistic": ("artistic", r"artistic licen[sc]e", "artistic"),
    "boost": ("boost", r"boost software licen[sc]e", "bsl 1 0"),
    "busl": ("business", r"business source licen[sc]e", "busl 1 1"),
    "zlib": ("zlib", r"zlib(?: libpng)? licen[sc]e", "zlib"),
    "libpng": ("libpng", r"libpng licen[sc]e", "libpng"),
    "openssl": ("openssl", r"openssl licen[sc]e", "openssl"),
    "python": ("python", r"python(?: software foundation)? licen[sc]e", "python 2 0"),
    "php": ("php", r"php licen[sc]e", "php 3 01"),
    "ruby": ("ruby", r"ruby licen[sc]e", "ruby"),
    "postgresql": ("postgresql", r"postgresql licen[sc]e", "postgresql"),
    "unlicense": ("unlicense", r"unlicense", "unlicense"),
    "wtfpl": ("wtfpl", r"wtfpl", "wtfpl"),
    "ofl": ("font", r"(?:sil )?open font licen[sc]e", "ofl 1 1"),
    "odbl": ("database", r"open database licen[sc]e", "odbl 1 0"),
    "odc-by": ("data", r"open data commons attribution licen[sc]e", "odc by 1 0"),
    "ncsa": ("ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e", "ncsa"),
    "osl": ("open", r"open software licen[sc]e", "osl 3 0"),
    "afl": ("academic", r"academic free licen[sc]e", "afl 3 0"),
    "qpl": ("public", r"q public licen[sc]e", "qpl 1 0"),
    "sspl": ("side", r"server side public licen[sc]e", "sspl 1 0"),
    "elastic": ("elastic", r"elastic licen[sc]e(?: 2 0)?", "elastic 2 0"),
    "cecill": ("cecill", r"cecill(?: [abc])?(?: licen[sc]e)?", "cecill 2 1"),
    "cc0": ("cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    "cc-by-nc-nd": ("cc", r"cc by nc nd(?: [1-4] [05])?", "cc by nc nd 4 0"),
    "cc-by-nc-sa": ("cc", r"cc by nc sa(?: [1-4] [05])?", "cc by nc sa 4 0"),
    "cc-by-nc": ("cc", r"cc by nc(?: [1-4] [05])?", "cc by nc 4 0"),
    "cc-by-nd": ("cc", r"cc by nd(?: [1-4] [05])?", "cc by nd 4 0"),
    "cc-by-sa": ("cc", r"cc by sa(?: [1-4] [05])?", "cc by sa 4 0"),
    "cc-by": ("cc", r"cc by(?: [1-4] [05])?", "cc by 4 0"),
    "cc-attribution-noncommercial": ("attribution", r"(?:creative commons )?attribution non ?commercial(?: share ?alike| no ?deriv[a-z]+)?", "cc by nc"),
    "cc-attribution-sharealike": ("attribution", r"(?:creative commons )?attribution share ?alike", "cc by sa"),
    "cc-attribution": ("attribution", r"creative commons attribution", "cc by"),
    "creative-commons": ("creative", r"creative commons(?: licen[sc]e)?", "cc"),
    "public-domain": ("domain", r"public domain(?: dedication)?", "pd"),
    "proprietary": ("licen", r"(?:proprietary|commercial) licen[sc]e", "proprietary"),
}
#: Names that are common words too count on their own only beside the word for a licence.
BARE = {"mit": r"(?:mit|mit x11|x11 mit) licen[sc]e"}
#: What may introduce a name; a detection that has it scores more.
INTRO = r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|redistributed|made available|dual licen[sc]ed|sublicen[sc]ed|offered|subject) (?:under|to|by) (?:(?:the )?terms (?:and conditions )?of )?(?:the |an? )?"
BARE_SCORE, INTRO_SCORE, SPDX_SCORE = 0.6, 0.95, 1.0
#: Rules for the words of notices, highest priority first: (label, keyword, expression on lower-case words, score)
NOTICES = [
    # MIT and its kin
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    ("mit", "merge", r"to use copy modify merge publish distribute sublicense and or sell copies of the software", 1.0),
    ("mit", "deal", r"to deal in the software without restriction including without limitation", 0.95),
    ("mit", "substantial", r"shall be included in all copies or substantial portions of the software", 0.95),
    ("mit", "arising", r"arising from out of or in connection with the software or the use or other dealings in the software", 0.9),
    ("mit", "copyright", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", 0.85),
    ("mit-0", "attribution", r"mit no attribution", 0.9),
    ("mit-advertising", "advertising", r"all advertising materials mentioning features or use of the software must", 0.7),
    ("x11", "advertising", r"shall not be used in advertising or otherwise to promote the sale use or other dealings in this software", 1.0),
    ("hpnd", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", 1.0),
    ("hpnd", "supporting", r"both that copyright notice and this permission notice appear in supporting documentation", 0.9),
    ("icu", "permission", r"both the above copyright notice s? ?and this permission notice appear in all copies of the software", 0.95),
    ("unicode", "unicode", r"a copy of the unicode data files and any associated documentation", 1.0),
    ("curl", "permission", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", 0.95),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 1.0),
    ("isc", "whatsoever", r"whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action", 0.9),
    ("isc", "disclaims", r"the author disclaims all warranties with regard to this software", 0.85),
    ("ncsa", "urbana", r"university of illinois at urbana champaign", 0.7),
    ("json", "evil", r"the software shall be used for good not evil", 1.0),
    ("beerware", "beer", r"you can buy me a beer in return", 1.0),
    ("beerware", "beer", r"the beer ?ware licen[sc]e", 0.9),
    # BSD
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1.0),
    ("bsd-4-clause", "berkeley", r"this product includes software developed by the university of california berkeley", 0.95),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission", 1.0),
    ("bsd-3-clause", "endorse", r"neither the names? of .{1,80}? nor the names of its contributors may be used to endorse", 1.0),
    ("bsd-3-clause-clear", "patent", r"no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e", 0.95),
    ("bsd-3-clause-nuclear", "nuclear", r"not designed licen[sc]ed or intended for use in the design construction operation or maintenance of any nuclear facility", 0.95),
    ("bsd-2-clause-patent", "patent", r"each copyright holder and contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable patent licen[sc]e", 0.8),
    ("bsd-2-clause-views", "views", r"the views and conclusions contained in the software and documentation are those of the authors", 0.9),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice", 0.95),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", 0.95),
    ("bsd", "regents", r"the regents of the university of california", 0.7),
    ("bsd", "procurement", r"including but not limited to procurement of substitute goods or services", 0.7),
    ("0bsd", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is granted", 0.95),
    # Apache
    ("apache-2.0", "compliance", r"you may not use this (?:file|work|software) except in compliance with the licen[sc]e", 0.95),
    ("apache-2.0", "apache", r"you may obtain a copy of the licen[sc]e at (?:https? )?www apache org licen[sc]es licen[sc]e 2 0", 1.0),
    ("apache-2.0", "apache", r"www apache org licen[sc]es licen[sc]e 2 0", 0.95),
    ("apache-2.0", "governing", r"see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e", 0.9),
    ("apache-2.0", "sections", r"as defined by sections 1 through 9 of this document", 0.85),
    ("apache-2.0", "contributor", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e", 1.0),
    ("apache-2.0", "applicable", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis", 0.9),
    ("apache-2.0", "patent", r"any patent licen[sc]es granted to you under this licen[sc]e for that work shall terminate", 0.85),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation", 0.9),
    ("apache-1.1", "apache", r"the names apache and apache software foundation must not be used to endorse", 0.95),
    ("apache-1.0", "apache", r"software developed by the apache group for use in the apache http server project", 1.0),
    ("apache-contributor", "contributor", r"licen[sc]ed to the apache software foundation asf under one or more contributor licen[sc]e agreements", 0.95),
    # GNU
    ("agpl-3.0", "affero", r"under the terms of the gnu affero general public licen[sc]e as published by the free software foundation either version 3", 1.0),
    ("agpl", "affero", r"you should have received a copy of the gnu affero general public licen[sc]e along with this program", 0.95),
    ("agpl", "remotely", r"all users interacting with it remotely through a computer network an opportunity to receive the corresponding source", 0.95),
    ("lgpl-2.1", "lesser", r"under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1", 1.0),
    ("lgpl-3.0", "lesser", r"under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 3", 1.0),
    ("lgpl-2.0", "library", r"under the terms of the gnu library general public licen[sc]e as published by the free software foundation either version 2", 1.0),
    ("lgpl", "lesser", r"you should have received a copy of the gnu lesser general public licen[sc]e along with this library", 0.95),
    ("lgpl", "library", r"a work that uses the library in isolation is not a derivative work of the library", 0.9),
    ("gpl-1.0", "foundation", r"gnu general public licen[sc]e as published by the free software foundation either version 1", 1.0),
    ("gpl-2.0", "foundation", r"gnu general public licen[sc]e as published by the free software foundation (?:either )?version 2", 1.0),
    ("gpl-3.0", "foundation", r"gnu general public licen[sc]e as published by the free software foundation (?:either )?version 3", 1.0),
    ("gpl", "redistribute", r"redistribute it and or modify it under the terms of the gnu general public licen[sc]e", 1.0),
    ("gpl", "hope", r"distributed in the hope that it will be useful but without any warranty", 0.9),
    ("gpl", "along", r"you should have received a copy of the gnu general public licen[sc]e along with this (?:program|software|file)", 0.95),
    ("gpl", "franklin", r"free software foundation inc 51 franklin (?:street|st) fifth floor boston", 0.85),
    ("gpl", "temple", r"free software foundation inc 59 temple place suite 330 boston", 0.85),
    ("gpl", "freedom", r"designed to take away your freedom to share and change it", 0.9),
    ("gpl", "freedom", r"intended to guarantee your freedom to share and change (?:all versions of a program|free software)", 0.9),
    ("gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed", 0.85),
    ("gpl", "absolutely", r"comes with absolutely no warranty for details type show w", 0.85),
    ("gpl-exception", "exception", r"as a special exception (?:the copyright holders|you may|the free software foundation|if you link)", 0.8),
    ("gpl-classpath", "linking", r"linking this library statically or dynamically with other modules is making a combined work based on this library", 0.95),
    ("gpl-classpath", "classpath", r"classpath exception", 0.85),
    ("gpl-bison", "bison", r"special exception .{0,40}?bison", 0.8),
    ("gpl-autoconf", "autoconf", r"configuration script generated by autoconf", 0.85),
    ("gpl-font", "font", r"if you create a document which uses this font and embed this font", 0.9),
    ("gpl-gcc", "gcc", r"gcc runtime library exception", 0.95),
    ("fdl", "documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", 1.0),
    ("fdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts", 0.95),
    ("copyleft", "copyleft", r"copyleft licen[sc]e", 0.5),
    # Mozilla, Eclipse, CDDL and other weak copyleft
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", 1.0),
    ("mpl-2.0", "mozilla", r"if a copy of the mpl was not distributed with this file you can obtain one at (?:https? )?mozilla org mpl 2 0", 1.0),
    ("mpl-2.0", "incompatible", r"incompatible with secondary licen[sc]es as defined by the mozilla public licen[sc]e", 0.95),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1", 1.0),
    ("mpl-tri", "alternatively", r"alternatively the contents of this file may be used under the terms of either the gnu general public licen[sc]e", 0.9),
    ("npl", "netscape", r"netscape public licen[sc]e", 0.9),
    ("epl-1.0", "eclipse", r"www eclipse org legal epl v10", 1.0),
    ("epl-2.0", "eclipse", r"www eclipse org legal epl 2 0", 1.0),
    ("epl", "accompanying", r"the accompanying materials are (?:provided|made available) under the terms of the eclipse public licen[sc]e", 0.95),
    ("epl", "recipient", r"any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement", 0.85),
    ("edl", "eclipse", r"www eclipse org org documents edl v10", 1.0),
    ("cddl", "common", r"subject to the terms of the common development and distribution licen[sc]e", 0.95),
    ("cddl", "header", r"do not alter or remove copyright notices or this (?:file )?header", 0.7),
    ("cddl", "cddl", r"cddl (?:1 0|1 1|header start)", 0.9),
    ("cpl", "common", r"provided under the terms of this common public licen[sc]e", 0.95),
    ("cpal", "attribution", r"common public attribution licen[sc]e", 0.95),
    ("eupl", "eupl", r"licen[sc]ed under the eupl", 0.95),
    ("eupl", "eupl", r"eupl(?: v)? 1 [012]", 0.9),
    ("osl", "open", r"licen[sc]ed under the open software licen[sc]e version 3 0", 0.95),
    ("afl", "academic", r"licen[sc]ed under the academic free licen[sc]e version [23] [01]", 0.95),
    ("sissl", "sun", r"sun industry standards source licen[sc]e", 0.95),
    ("ipl", "ibm", r"ibm public licen[sc]e", 0.9),
    ("lppl", "latex", r"latex project public licen[sc]e", 0.95),
    ("lppl", "maintenance", r"this work has the lppl maintenance status", 1.0),
    ("apsl", "apple", r"apple public source licen[sc]e", 0.95),
    ("ms-pl", "trademark", r"a trademark licen[sc]e to use any contributors name logo or trademarks", 0.6),
    ("ms-lpl", "microsoft", r"microsoft limited public licen[sc]e", 0.95),
    ("artistic", "perl", r"under the same terms as perl itself", 0.85),
    ("artistic", "perl", r"you can redistribute it and or modify it under the same terms as perl", 0.95),
    ("artistic-1.0", "package", r"the intent of this document is to state the conditions under which a package may be copied", 1.0),
    ("artistic-2.0", "package", r"establishes the terms under which a given free software package may be copied modified distributed", 1.0),
    ("ruby", "redistribute", r"you can redistribute it and or modify it under either the terms of the (?:2 clause bsdl|gpl)", 0.9),
    # permissive ones with words of their own
    ("boost", "organization", r"to any person or organization obtaining a copy of the software and accompanying documentation", 1.0),
    ("boost", "boost", r"distributed under the boost software licen[sc]e version 1 0", 1.0),
    ("boost", "machine", r"solely in the form of machine executable object code generated by a source language processor", 0.95),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 1.0),
    ("zlib", "altered", r"altered source versions must be plainly marked as such", 0.95),
    ("zlib", "held", r"in no event will the authors be held liable for any damages arising from the use of this software", 0.9),
    ("libpng", "png", r"the png reference library is supplied as is", 1.0),
    ("libpng", "png", r"png reference library version", 0.7),
    ("libtiff", "silicon", r"the names of sam leffler and silicon graphics may not be used", 1.0),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group", 1.0),
    ("freetype", "freetype", r"portions of this software are copyright .{0,40}?the freetype project", 0.95),
    ("freetype", "freetype", r"the freetype project licen[sc]e", 0.95),
    ("openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", 1.0),
    ("openssl", "openssl", r"the names openssl toolkit and openssl project must not be used to endorse", 1.0),
    ("ssleay", "eric", r"this product includes cryptographic software written by eric young", 1.0),
    ("php", "php", r"this product includes php software freely available from", 1.0),
    ("php", "php", r"products derived from this software may not be called php", 1.0),
    ("zend", "zend", r"zend engine licen[sc]e", 0.95),
    ("python", "psf", r"psf hereby grants licensee a nonexclusive royalty free world wide licen[sc]e", 1.0),
    ("python", "python", r"psf licen[sc]e agreement for python", 0.95),
    ("cnri-python", "cnri", r"cnri (?:open source )?licen[sc]e agreement", 0.95),
    ("postgresql", "agreement", r"without a written agreement is hereby granted provided that the above copyright notice", 0.9),
    ("tcl", "tcl", r"tcl tk licen[sc]e", 0.95),
    ("tcl", "authors", r"the authors hereby grant permission to use copy modify distribute and licen[sc]e this software and its documentation", 1.0),
    ("vim", "vim", r"vim licen[sc]e", 0.9),
    ("w3c", "w3c", r"w3c software (?:and document )?(?:notice and )?licen[sc]e", 0.95),
    ("ntp", "delaware", r"the university of delaware makes no representations about the suitability this software", 0.95),
    ("sleepycat", "sleepycat", r"sleepycat licen[sc]e", 0.95),
    ("sleepycat", "accompanying", r"how to obtain complete source code for the .{1,20}? software and any accompanying software", 0.9),
    ("ofl", "font", r"this font software is licen[sc]ed under the sil open font licen[sc]e", 1.0),
    ("ofl", "reserved", r"with reserved font name", 0.9),
    ("ofl", "sold", r"neither the font software nor any of its individual components .{0,60}?may be sold by itself", 0.95),
    ("bitstream-vera", "bitstream", r"bitstream vera is a trademark of bitstream", 0.95),
    ("blueoak", "oak", r"blue oak model licen[sc]e", 0.95),
    ("mulan", "mulan", r"mulan permissive software licen[sc]e", 0.95),
    ("upl", "permissive", r"universal permissive licen[sc]e", 0.95),
    # public domain
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 1.0),
    ("unlicense", "anyone", r"anyone is free to copy modify publish use compile sell or distribute this software", 1.0),
    ("unlicense", "unlicense", r"for more information please refer to (?:https? )?unlicense org", 1.0),
    ("wtfpl", "want", r"do what the fuck you want to public licen[sc]e", 1.0),
    ("wtfpl", "want", r"you just do what the fuck you want to", 1.0),
    ("cc0", "waived", r"has waived all copyright and related or neighbou?ring rights", 1.0),
    ("cc0", "publicdomain", r"creativecommons org publicdomain zero 1 0", 1.0),
    ("cc-pdm", "publicdomain", r"creativecommons org publicdomain mark 1 0", 1.0),
    ("pddl", "dedication", r"open data commons public domain dedication and licen[sc]e", 1.0),
    ("public-domain", "domain", r"(?:placed|released|put|dedicated) (?:in|into|to) the public domain", 0.9),
    ("public-domain", "domain", r"(?:this (?:file|work|code|software) is|is hereby) in the public domain", 0.85),
    ("public-domain", "government", r"work of the united states government", 0.6),
    # Creative Commons by their addresses and deeds
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licen[sc]es by nc nd(?: [1-4] [05])?", 1.0),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licen[sc]es by nc sa(?: [1-4] [05])?", 1.0),
    ("cc-by-nc", "creativecommons", r"creativecommons org licen[sc]es by nc(?: [1-4] [05])?", 1.0),
    ("cc-by-nd", "creativecommons", r"creativecommons org licen[sc]es by nd(?: [1-4] [05])?", 1.0),
    ("cc-by-sa", "creativecommons", r"creativecommons org licen[sc]es by sa(?: [1-4] [05])?", 1.0),
    ("cc-by", "creativecommons", r"creativecommons org licen[sc]es by(?: [1-4] [05])?", 1.0),
    ("cc-by-nc-nd", "attribution", r"attribution non ?commercial no ?derivatives [1-4] [05]", 0.95),
    ("cc-by-nd", "attribution", r"attribution no ?derivatives [1-4] [05]", 0.95),
    ("creative-commons", "reserved", r"some rights reserved", 0.6),
    ("open-government", "government", r"contains public sector information licen[sc]ed under the open government licen[sc]e", 1.0),
    ("odbl", "database", r"made available under the open database licen[sc]e", 1.0),
    # source available and proprietary
    ("sspl", "service", r"if you make the functionality of the program or a modified version available to third parties as a service", 0.95),
    ("busl", "licensor", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", 1.0),
    ("busl", "change", r"effective on the change date or the fourth anniversary", 0.9),
    ("commons-clause", "commons", r"commons clause licen[sc]e condition", 1.0),
    ("commons-clause", "sell", r"the grant of rights under the licen[sc]e will not include and the licen[sc]e does not grant to you the right to sell", 0.95),
    ("elastic", "managed", r"you may not provide the software to third parties as a hosted or managed service", 1.0),
    ("polyform", "polyform", r"polyform (?:noncommercial|shield|perimeter|strict|small business|free trial|internal use) licen[sc]e", 0.95),
    ("llama", "community", r"llama(?: [23](?: [0-9])?)? community licen[sc]e", 0.95),
    ("openrail", "responsible", r"(?:open )?responsible ai licen[sc]e", 0.9),
    ("openrail", "rail", r"(?:(?:creativeml|bigscience|bigcode) )?open ?rail(?: m)?", 0.85),
    ("eula", "end", r"end user licen[sc]e agreement", 0.8),
    ("eula", "software", r"by (?:installing|downloading|copying|using) (?:or otherwise using )?(?:the|this) software you (?:agree|accept)", 0.75),
    ("eula", "decompile", r"you (?:may|shall) not (?:modify )?reverse engineer decompile or disassemble", 0.8),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)", 0.8),
    ("proprietary", "unauthori", r"unauthori[sz]ed (?:copying|use|reproduction|distribution) of this (?:file|software|document|work)", 0.8),
    ("proprietary", "trade", r"(?:contains|constitutes) (?:the )?trade secrets? (?:and|of)", 0.7),
    ("proprietary", "personal", r"for personal (?:and )?non ?commercial use only", 0.6),
    ("proprietary", "evaluation", r"for evaluation purposes only", 0.5),
    ("proprietary", "without", r"without the (?:express|prior) (?:prior )?written (?:permission|consent) of", 0.6),
    ("no-redistribution", "may", r"may not be (?:reproduced|redistributed|copied)", 0.7),
    ("no-redistribution", "part", r"no part of this (?:publication|book|document|work) may be reproduced", 0.8),
    ("no-training", "training", r"may not be used (?:for|in) (?:the )?training (?:of )?(?:ai|machine learning|language models?)", 0.8),
    ("all-rights", "rechte", r"alle rechte vorbehalten", 0.7),
    ("all-rights", "droits", r"tous droits reserves", 0.7),
    ("reserved", "reserved", r"all rights reserved", 0.7),
    # notices that any licence may have
    ("warranty-disclaimer", "warranty", r"the software is provided as is without warranty of any kind", 0.6),
    ("warranty-disclaimer", "merchantability", r"warranties of merchantability (?:and )?fitness for a particular purpose(?: and non ?infringement)?", 0.5),
    ("warranty-disclaimer", "warranty", r"without warranty of any kind", 0.4),
    ("warranty-disclaimer", "warranties", r"without warranties or conditions of any kind", 0.4),
    ("liability-disclaimer", "consequential", r"(?:indirect|direct) (?:indirect )?incidental special exemplary or consequential damages", 0.4),
    ("as-is", "provided", r"provided as is", 0.3),
    ("trademark", "trademark", r"(?:are|is) (?:a )?(?:registered )?trademarks? of (?:their|its) respective owners?", 0.3),
    ("copyright-notice", "copyright", r"copyright(?: c)? (?:19|20)[0-9]{2}", 0.5),
    ("copyright-notice", "copyright", r"copyright holders?", 0.3),
    ("licence-file", "see", r"see (?:the )?(?:file )?licen[sc]e(?: txt| md)? (?:file )?(?:for|in) (?:details|more|the root|full|terms)", 0.4),
    ("licence-file", "found", r"licen[sc]e that can be found in the licen[sc]e file", 0.7),
]


def rules() -> list[tuple[int, str, str, str, float]]:
    """(priority, label, keyword, expression, score), in order of priority: notices, identifiers, names."""
    found = list(NOTICES)
    found += [(label, "spdx", rf"spdx licen[sc]e identifier {spdx}(?: or later| only)?", SPDX_SCORE) for label, (_, _, spdx) in NAMES.items()]
    for label, (word, name, _) in NAMES.items():
        found.append((label, word, rf"{INTRO}{name}|{BARE[label]}" if label in BARE else rf"(?:{INTRO})?{name}", BARE_SCORE))
    return [(i, label.removesuffix("-short"), word, rf"(?<= )(?:{pattern})(?= )", score) for i, (label, word, pattern, score) in enumerate(found)]


#: Parts of words that most detections have; they are looked for before any rule.
_COMMON = ["licen", "reserved", "spdx", "creative", "copyright", "warranty", "permission", "redistribut", "reproduced", "copied", "gpl", "bsd", "cc0", "cecill", "wtfpl", "domain", "provided", "under"]
#: Two words that the gate looks for together.
_CC = "cc by"


def required(pattern: str) -> list[list[str]]:
    """Lists of literals within words; each match of the pattern has one or more of each list."""
    return _required(parser.parse(pattern))


def _required(items) -> list[list[str]]:
    found, run = [], ""
    for kind, what in [*items, (None, None)]:
        if kind is parser.LITERAL:
            run += chr(what)
            continue
        found += [[_CC]] * (_CC in run) + [[w] for w in run.split(" ") if w]
        run = ""
        if kind is parser.SUBPATTERN:
            found += _required(what[-1])
        elif kind is parser.MAX_REPEAT and what[0] > 0:
            found += _required(what[2])
        elif kind is parser.BRANCH:
            parts = [_required(p) for p in what[1]]
            if all(parts):
                found.append([w for p in parts for w in _rarest(p)])
    return found


def _covered(words: list[str], gate: list[str]) -> bool:
    return all(w == _CC or any(g in w for g in gate) for w in words)


def _rarest(lists: list[list[str]]) -> list[str]:
    return next((x for x in lists if _covered(x, _COMMON)), None) or max(lists, key=lambda x: min(map(len, x)))


def _gate() -> list[str]:
    """Each detection has one of these parts of words, or the two words beside them: the common
    parts, and for each rule that they do not cover the literals that its matches must have."""
    gate = list(_COMMON)
    for _, _, _, pattern, _ in rules():
        lists = required(pattern)
        if not any(_covered(x, gate) for x in lists):
            gate += _rarest(lists)
    return gate


GATE = _gate()


def gated(text: Column) -> Column:
    """Whether a text may hold a detection, by plain search in its lower case."""

    def any_part(low: Column) -> Column:
        found = F.lit(False)
        for part in GATE:
            found = found | F.contains(low, F.lit(part))
        return found | (F.contains(low, F.lit("cc")) & low.rlike(f"cc{GAP}by"))

    return any_part(F.lower(text))


def _spaces(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def _detections(line: Column, rule: Column) -> Column:
    """Intervals of words of a rule's matches on the line."""
    hits = F.regexp_extract_all(line, rule["pattern"], F.lit(0))
    return let(hits, lambda found: F.when(F.size(found) > 0, _intervals(line, rule, found)).otherwise(F.expr("cast(array() as array<struct<start:int,order:int,priority:int,label:string,score:double>>)")))


#: Hits of a run; within a run each hit copies those before it, so a text's cost is linear in its hits.
RUN = 64


def _in_runs(step: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    """Folds pairs in runs by ``step``, each from the words before it, and joins what they found."""

    def fold(pairs: Column) -> Column:
        heads = F.sequence(F.lit(0), F.size(pairs) - 1, F.lit(RUN))
        part = lambda h: F.slice(pairs, h + 1, F.lit(RUN))
        sizes = F.transform(heads, lambda h: F.aggregate(part(h), F.lit(0), lambda n, p: n + _spaces(p["gap"]) + _spaces(p["hit"])))
        before = F.aggregate(sizes, F.array(F.lit(0)).cast("array<int>"), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        empty = F.expr("cast(array() as array<struct<start:int,end:int,introduced:boolean>>)").alias("found")
        starts = F.slice(before, F.lit(1), F.size(heads))
        return F.flatten(F.zip_with(heads, starts, lambda h, at: F.aggregate(part(h), F.struct(at.alias("at"), empty), step)["found"]))

    return fold


def _intervals(line: Column, rule: Column, hits: Column) -> Column:
    between = F.split(line, rule["pattern"], F.lit(-1))

    def step(acc: Column, pair: Column) -> Column:
        first = acc["at"] + _spaces(pair["gap"])
        last = first + _spaces(pair["hit"])
        return F.struct(last.alias("at"), F.concat(acc["found"], F.array(F.struct((first - 1).alias("start"), last.alias("end"), pair["hit"].rlike(f"^{INTRO}").alias("introduced")))).alias("found"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    spans = let(pairs, _in_runs(step))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("order"), rule["priority"].alias("priority"), rule["label"].alias("label"), F.when(s["introduced"], F.greatest(rule["score"], F.lit(INTRO_SCORE))).otherwise(rule["score"]).alias("score")))


def detect(line: Column) -> Column:
    """struct(labels, score) of the detections that are not suppressed."""
    struct = ",".join(f"named_struct('priority',{p},'label','{label}','word','{word}','pattern',r'{pattern}','score',{score}D)" for p, label, word, pattern, score in rules())
    table = F.expr(f"array({struct})")
    words = sorted({word for _, _, word, _, _ in rules()})
    # the line is searched once for each keyword, not for each rule
    present = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(line, w))
    fitting = let(present, lambda ws: F.filter(table, lambda r: F.array_contains(ws, r["word"])))
    found = F.array_sort(F.flatten(F.transform(fitting, lambda r: _detections(line, r))))
    nothing = F.expr("cast(array() as array<string>)")
    none = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("priority"), nothing.alias("held"), F.lit(0.0).alias("score"), nothing.alias("labels"), F.lit(0.0).alias("best"))

    def take(acc: Column, d: Column) -> Column:
        end = -d["order"]
        # the detection at hand waits, for the next may overlap it with a higher priority
        over = F.struct(end.alias("end"), d["priority"].alias("priority"), F.array(d["label"]).alias("held"), d["score"].alias("score"), acc["labels"].alias("labels"), acc["best"].alias("best"))
        after = F.struct(end.alias("end"), d["priority"].alias("priority"), F.array(d["label"]).alias("held"), d["score"].alias("score"), F.array_union(acc["labels"], acc["held"]).alias("labels"), F.greatest(acc["best"], acc["score"]).alias("best"))
        beyond = d["start"] >= acc["end"]
        wins = (end > acc["end"]) & (d["priority"] < acc["priority"])
        return F.when(beyond, after).when(wins, over).otherwise(acc)

    return F.aggregate(found, none, take, lambda acc: F.struct(F.array_union(acc["labels"], acc["held"]).alias("labels"), F.greatest(acc["best"], acc["score"]).alias("score")))


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split(" ")
    same = lambda i: F.get(words, i) == parts[0]
    whole = lambda i: same(i) if len(parts) == 1 else same(i) & F.aggregate(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in enumerate(parts)]), F.lit(True), lambda acc, x: acc & F.coalesce(F.get(words, i + x["k"]) == x["p"], F.lit(False)))
    return F.filter(F.transform(words, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull() & whole(i))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))

    def read(words: Column) -> Column:
        places = F.array(*[F.struct(F.lit(label).alias("label"), _places(words, phrase).alias("at")) for phrase, label in BASE.items()])
        line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        return F.struct(places.alias("base"), let(line, detect).alias("more"))

    words = F.regexp_extract_all(F.translate(F.col("text"), UPPER, LOWER), F.lit(WORD), F.lit(0))
    found = F.when(gated(F.col("text")), let(words, read))
    rows = rows.select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), found.alias("found"))
    places = F.coalesce(F.flatten(F.col("found.base.at")), F.expr("cast(array() as array<int>)"))
    base = F.coalesce(F.transform(F.filter("found.base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"]), F.expr("cast(array() as array<string>)"))
    more = F.coalesce(F.col("found.more.labels"), F.expr("cast(array() as array<string>)"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, more)).alias("labels"),
        F.coalesce(F.col("found.more.score"), F.lit(0.0)).alias("score"),
    )


def op9_query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
