"""License scan by ordered signature rules.

Hand-written regular expressions over lower-cased words, each behind keywords of which the text must
hold one; rules have a priority, and of overlapping detections the one contained in another is
suppressed, then of equal intervals or partial overlaps the one of the later rule.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import small_batches
from .textbytes import LOWER, Words, chunks, strings

#: The base phrases and their labels; their places are always reported.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Signatures run over the words of a text joined by single spaces.
_LICENSE = "(?:licen[cs]e|licen[cs]es|licen[cs]ing)"
_V = "(?: version| v)?"
#: label, keywords (each alternative of identifier and name holds one as a whole word), identifier, name: each gives rules for the tag, the notice and the reference.
FAMILIES = (
    ("mit", "mit", "mit", "mit"),
    ("mit-0", "mit", "mit 0", "mit no attribution"),
    ("x11", "x11", "x11", "(?:mit )?x11"),
    ("isc", "isc", "isc", "isc"),
    ("0bsd", "bsd 0bsd", "0bsd", "(?:bsd zero clause|zero clause bsd)"),
    ("bsd-1-clause", "bsd", "bsd 1 clause", "(?:bsd 1 clause|1 clause bsd|one clause bsd)"),
    ("bsd-2-clause", "bsd freebsd", "bsd 2 clause", "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", "bsd 3 clause", "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", "bsd 4 clause", "(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)"),
    ("bsd-3-clause-clear", "bsd", "bsd 3 clause clear", "(?:clear bsd|bsd 3 clause clear)"),
    ("apache-1.0", "apache", "apache 1 0", f"apache(?: software)?(?: {_LICENSE})?{_V} 1 0"),
    ("apache-1.1", "apache", "apache 1 1", f"apache(?: software)?(?: {_LICENSE})?{_V} 1 1"),
    ("apache-2", "apache", "apache 2 0", f"apache(?: software)?(?: {_LICENSE})?{_V} 2(?: 0)?"),
    ("gpl-1.0", "gpl general", "gpl 1 0(?: only| or later)?", f"(?:gnu )?(?:gpl|general public {_LICENSE}){_V} 1(?: 0)?"),
    ("gpl-2.0", "gpl gplv2 gpl2", "gpl 2 0(?: only)?", "(?:gnu )?gpl ?v?2(?: 0)?(?: only)?"),
    ("gpl-2.0+", "gpl gplv2 gpl2", "gpl 2 0 (?:or later|plus)", "(?:gnu )?gpl ?v?2(?: 0)? or later"),
    ("gpl-3.0", "gpl gplv3 gpl3", "gpl 3 0(?: only)?", "(?:gnu )?gpl ?v?3(?: 0)?(?: only)?"),
    ("gpl-3.0+", "gpl gplv3 gpl3", "gpl 3 0 (?:or later|plus)", "(?:gnu )?gpl ?v?3(?: 0)? or later"),
    ("gpl-2.0", "general gplv2", "gplv2", f"gnu general public {_LICENSE}{_V} 2(?: 0)?"),
    ("gpl-3.0", "general gplv3", "gplv3", f"gnu general public {_LICENSE}{_V} 3(?: 0)?"),
    ("lgpl-2.0", "lgpl lgplv2 lgpl2", "lgpl 2 0(?: only| or later)?", "(?:gnu )?lgpl ?v?2(?: 0)?"),
    ("lgpl-2.1", "lgpl lgplv2 lgpl2", "lgpl 2 1(?: only| or later)?", "(?:gnu )?lgpl ?v?2 1"),
    ("lgpl-3.0", "lgpl lgplv3 lgpl3", "lgpl 3 0(?: only| or later)?", "(?:gnu )?lgpl ?v?3(?: 0)?"),
    ("lgpl-2.1", "lesser lgplv2", "lgplv2 1", f"gnu lesser general public {_LICENSE}{_V} 2 1"),
    ("lgpl-3.0", "lesser lgplv3", "lgplv3", f"gnu lesser general public {_LICENSE}{_V} 3(?: 0)?"),
    ("agpl-1.0", "affero agpl", "agpl 1 0", f"affero general public {_LICENSE}{_V} 1(?: 0)?"),
    ("agpl-3.0", "agpl agplv3 agpl3", "agpl 3 0(?: only| or later)?", "(?:gnu )?agpl ?v?3(?: 0)?"),
    ("agpl-3.0", "affero agplv3", "agplv3", f"(?:gnu )?affero general public {_LICENSE}{_V} 3(?: 0)?"),
    ("gfdl-1.2", "documentation gfdl", "gfdl 1 2(?: only| or later)?", f"gnu free documentation {_LICENSE}{_V} 1 2"),
    ("gfdl-1.3", "documentation gfdl", "gfdl 1 3(?: only| or later)?", f"gnu free documentation {_LICENSE}{_V} 1 3"),
    ("mpl-1.0", "mozilla mpl", "mpl 1 0", f"mozilla public {_LICENSE}{_V} 1 0"),
    ("mpl-1.1", "mozilla mpl", "mpl 1 1", f"mozilla public {_LICENSE}{_V} 1 1"),
    ("mpl-2.0", "mozilla mpl", "mpl 2 0", f"mozilla public {_LICENSE}{_V} 2(?: 0)?"),
    ("mpl-2.0", "mpl mplv2", "mplv2", f"mpl{_V} 2(?: 0)?"),
    ("epl-1.0", "eclipse epl", "epl 1 0", f"eclipse public {_LICENSE}{_V} 1 0"),
    ("epl-2.0", "eclipse epl", "epl 2 0", f"eclipse public {_LICENSE}{_V} 2 0"),
    ("edl-1.0", "eclipse edl", "edl 1 0", f"eclipse distribution {_LICENSE}{_V} 1 0"),
    ("cddl-1.0", "cddl", "cddl 1 0", "cddl(?: 1 0)?"),
    ("cddl-1.1", "cddl", "cddl 1 1", "cddl 1 1"),
    ("cddl-1.0", "development cddl", "cddl", f"common development and distribution {_LICENSE}"),
    ("cpl-1.0", "common cpl", "cpl 1 0", f"common public {_LICENSE}{_V}(?: 1 0)?"),
    ("ipl-1.0", "ibm ipl", "ipl 1 0", f"ibm public {_LICENSE}"),
    ("eupl-1.1", "eupl european", "eupl 1 1", "(?:eupl|european union public licence)(?: v)? 1 1"),
    ("eupl-1.2", "eupl european", "eupl 1 2", "(?:eupl|european union public licence)(?: v)? 1 2"),
    ("osl-3.0", "open osl", "osl 3 0", f"open software {_LICENSE}(?: v)? 3 0"),
    ("afl-3.0", "academic afl", "afl 3 0", f"academic free {_LICENSE}(?: v)? 3 0"),
    ("artistic-1.0", "artistic", "artistic 1 0(?: perl| cl8)?", f"artistic {_LICENSE} 1 0"),
    ("artistic-2.0", "artistic", "artistic 2 0", f"artistic {_LICENSE} 2 0"),
    ("zlib", "zlib", "zlib", "zlib"),
    ("libpng", "libpng", "libpng(?: 2 0)?", "libpng"),
    ("bsl-1.0", "boost bsl", "bsl 1 0", f"boost software {_LICENSE}(?: version)?(?: 1 0)?"),
    ("busl-1.1", "business busl", "busl 1 1", f"business source {_LICENSE}(?: 1 1)?"),
    ("sspl-1.0", "side sspl", "sspl 1 0", f"server side public {_LICENSE}"),
    ("elastic-2.0", "elastic", "elastic 2 0", f"elastic {_LICENSE}(?: 2 0)?"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl fuck", "wtfpl", "(?:wtfpl|do what the fuck you want to public license)"),
    ("cc0-1.0", "cc0", "cc0 1 0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "by attribution", "cc by(?: [1-4] 0)?", "(?:cc by|creative commons attribution)(?: [1-4] 0)?(?: international)?"),
    ("cc-by-sa", "sa attribution", "cc by sa(?: [1-4] 0)?", "(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] 0)?(?: international)?"),
    ("cc-by-nd", "nd attribution", "cc by nd(?: [1-4] 0)?", "(?:cc by nd|creative commons attribution no ?derivatives)(?: [1-4] 0)?(?: international)?"),
    ("cc-by-nc", "nc attribution", "cc by nc(?: [1-4] 0)?", "(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] 0)?(?: international)?"),
    ("cc-by-nc-sa", "nc attribution", "cc by nc sa(?: [1-4] 0)?", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] 0)?"),
    ("cc-by-nc-nd", "nc attribution", "cc by nc nd(?: [1-4] 0)?", "(?:cc by nc nd|creative commons attribution non ?commercial no ?derivatives)(?: [1-4] 0)?"),
    ("odbl-1.0", "odbl database", "odbl 1 0", f"(?:odbl|open (?:data commons open )?database {_LICENSE})(?: v)?(?: 1 0)?"),
    ("pddl-1.0", "pddl dedication", "pddl 1 0", "(?:pddl|public domain dedication and license)"),
    ("odc-by-1.0", "odc attribution", "odc by 1 0", f"(?:odc by|open data commons attribution {_LICENSE})"),
    ("ofl-1.1", "ofl sil", "ofl 1 1(?: rfn| no rfn)?", "(?:ofl|sil open font license)(?: version)?(?: 1 1)?"),
    ("psf-2.0", "python psf", "psf 2 0", f"(?:python software foundation|psf) {_LICENSE}(?: version 2)?"),
    ("python-2.0", "python", "python 2 0", f"python {_LICENSE}"),
    ("php-3.0", "php", "php 3 0", f"php {_LICENSE}{_V} 3 0"),
    ("php-3.01", "php", "php 3 01", f"php {_LICENSE}{_V} 3 01"),
    ("ruby", "ruby", "ruby", "ruby"),
    ("vim", "vim", "vim", "vim"),
    ("ntp", "ntp", "ntp", "ntp"),
    ("curl", "curl", "curl", "curl"),
    ("openssl", "openssl", "openssl", "openssl"),
    ("ssleay", "ssleay", "ssleay", "ssleay"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("ncsa", "ncsa", "ncsa", f"(?:ncsa|university of illinois ncsa open source) {_LICENSE}"),
    ("ms-pl", "microsoft ms", "ms pl", f"microsoft public {_LICENSE}"),
    ("ms-rl", "microsoft ms", "ms rl", f"microsoft reciprocal {_LICENSE}"),
    ("lppl-1.3c", "lppl latex", "lppl 1 3c", "(?:lppl|latex project public license)(?: version)?(?: 1 3c?)?"),
    ("qpl-1.0", "qpl q", "qpl 1 0", "(?:qpl|q public license)(?: 1 0)?"),
    ("sleepycat", "sleepycat", "sleepycat", "sleepycat"),
    ("upl-1.0", "upl permissive", "upl 1 0", "(?:upl|universal permissive license)(?: 1 0)?"),
    ("mulan-psl-2.0", "mulan mulanpsl", "mulanpsl 2 0", "mulan p(?:ermissive )?s(?:oftware )?l(?:icense)?(?: v)? ?2"),
    ("ecl-2.0", "educational ecl", "ecl 2 0", f"educational community {_LICENSE}(?: version)? 2 0"),
    ("w3c", "w3c", "w3c", "w3c(?: software)?(?: notice and)?"),
    ("unicode", "unicode", "unicode dfs 201[56]", "unicode"),
    ("icu", "icu", "icu", "icu"),
    ("beerware", "beer beerware", "beerware", "(?:beerware|beer ware)"),
    ("json", "json", "json", "json"),
    ("blueoak-1.0.0", "oak blueoak", "blueoak 1 0 0", f"blue oak model {_LICENSE}(?: 1 0 0)?"),
    ("polyform-noncommercial-1.0.0", "polyform", "polyform noncommercial 1 0 0", f"polyform noncommercial {_LICENSE}"),
    ("commons-clause", "commons", "commons clause", f"commons clause(?: {_LICENSE})?"),
    ("openrail", "openrail", "(?:creativeml )?openrail", "(?:creativeml |bigscience )?openrail"),
)
#: label, keywords (each alternative of the signature holds one), signature, score: sentences of the license texts themselves, addresses, and unversioned mentions.
PASSAGES = (
    ("mit", "merge", "to use copy modify merge publish distribute sublicense and or sell", 1.0),
    ("mit", "noninfringement", "warranties of merchantability fitness for a particular purpose and noninfringement", 0.9),
    ("apache-2", "apache", "licensed under the apache license version 2 0 the license you may not use this file", 1.0),
    ("apache-2", "apache", "www apache org licenses license 2 0", 1.0),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee", 0.9),
    ("bsd-3-clause", "endorse", "neither the name of .{1,80}? may be used to endorse or promote products", 0.9),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software", 0.95),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice", 0.8),
    ("gpl", "gnu", "under the terms of the gnu general public license as published by the free software foundation", 0.9),
    ("gpl-2.0+", "either", "either version 2 of the license or at your option any later version", 0.95),
    ("gpl-3.0+", "either", "either version 3 of the license or at your option any later version", 0.95),
    ("lgpl", "lesser", "under the terms of the gnu lesser general public license", 0.9),
    ("mpl-2.0", "mozilla", "subject to the terms of the mozilla public license v 2 0", 1.0),
    ("bsl-1.0", "boost", "distributed under the boost software license version 1 0", 1.0),
    ("zlib", "altered", "altered source versions must be plainly marked as such", 0.95),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain", 1.0),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0", 1.0),
    ("cc-by", "creativecommons", "creativecommons org licenses by [1-4] [05]", 1.0),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa [1-4] [05]", 1.0),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc [1-4] [05]", 1.0),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd [1-4] [05]", 1.0),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa [1-4] [05]", 1.0),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd [1-4] [05]", 1.0),
    # permissive
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1.0),
    ("mit", "software", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.95),
    ("mit-0", "sell", "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided", 1.0),
    ("mit", "opensource", "(?:www )?opensource org licenses mit(?: license)?(?: php)?", 1.0),
    ("x11", "advertising", "except as contained in this notice the name of .{1,60}? shall not be used in advertising or otherwise to promote the sale", 0.95),
    ("isc", "opensource", "(?:www )?opensource org licenses isc(?: license)?", 1.0),
    ("isc", "author", "the software is provided as is and the author disclaims all warranties with regard to this software", 0.9),
    ("0bsd", "opensource", "(?:www )?opensource org licenses 0bsd", 1.0),
    ("bsd-2-clause", "opensource", "(?:www )?opensource org licenses bsd 2 clause", 1.0),
    ("bsd-3-clause", "opensource", "(?:www )?opensource org licenses bsd 3 clause", 1.0),
    ("bsd", "opensource", "(?:www )?opensource org licenses bsd license(?: php)?", 0.9),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice", 0.85),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that", 0.9),
    ("bsd-2-clause", "freebsd", "interpreted as representing official policies either expressed or implied of the freebsd project", 0.95),
    ("bsd-3-clause-clear", "patent", "no express or implied licenses to any party s patent rights are granted by this license", 0.95),
    ("bsd-4-clause", "berkeley", "this product includes software developed by the university of california berkeley and its contributors", 0.9),
    ("zlib", "origin", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", 0.95),
    ("zlib", "zlib", "(?:www )?zlib net zlib license html", 1.0),
    ("libpng", "png", "the png reference library is supplied as is", 0.95),
    ("curl", "curl", "curl (?:se|haxx se) docs copyright html", 1.0),
    ("ntp", "ntp", "the name .{1,60}? not be used in advertising or publicity pertaining to distribution of the ntp software", 0.85),
    ("postgresql", "postgresql", "postgresql database management system formerly known as postgres", 0.9),
    ("ncsa", "ncsa", "university of illinois ncsa open source license", 1.0),
    ("openssl", "openssl", "this product includes software developed by the openssl project", 0.95),
    ("ssleay", "eric", "this product includes cryptographic software written by eric young", 0.95),
    ("beerware", "beer", "you can buy me a beer in return", 0.95),
    ("json", "evil", "the software shall be used for good not evil", 1.0),
    ("wtfpl", "fuck", "you just do what the fuck you want to", 1.0),
    ("wtfpl", "wtfpl", "(?:www )?wtfpl net", 0.95),
    ("unlicense", "unlicense", "(?:for more information please refer to )?(?:http |https )?unlicense org", 0.95),
    ("unlicense", "dedicate", "the author or authors of this software dedicate any and all copyright interest in the software to the public domain", 0.95),
    ("bsl-1.0", "boost", "www boost org license 1 0 txt", 1.0),
    ("bsl-1.0", "executable", "machine executable object code generated by a source language processor", 0.95),
    ("w3c", "w3", "www w3 org consortium legal .{0,40}?copyright software", 0.95),
    ("unicode", "unicode", "www unicode org (?:copyright html|license(?: html| txt)?)", 1.0),
    ("unicode", "unicode", "unicode inc license agreement data files and software", 1.0),
    ("icu", "icu", "icu license icu 1 8 1 and later", 1.0),
    ("vim", "vim", "vim is charityware", 0.9),
    ("ruby", "ruby", "you can redistribute it and or modify it under the same terms as ruby(?: itself)?", 0.9),
    ("perl", "perl", "under the same terms as (?:the )?perl (?:5 )?(?:programming language )?(?:system )?itself", 0.95),
    ("python-2.0", "psf", "psf hereby grants licensee a nonexclusive royalty free world wide license", 0.95),
    ("php-3.01", "php", "this product includes php software freely available from", 0.9),
    ("afl-3.0", "academic", "licensed under the academic free license version 3 0", 1.0),
    ("upl-1.0", "larger", "larger works? .{1,80}? to which the software is contributed by such licensors", 0.85),
    ("ecl-2.0", "educational", "licensed under the educational community license version 2 0", 1.0),
    ("blueoak-1.0.0", "blueoakcouncil", "blueoakcouncil org license 1 0 0", 1.0),
    ("mulan-psl-2.0", "mulan mulanpsl2", "license coscl org cn mulanpsl2|you can use this software according to the terms and conditions of the mulan psl v2", 1.0),
    ("ms-pl", "microsoft", "this license governs use of the accompanying software .{0,200}? microsoft public license", 0.9),
    # Apache
    ("apache-2", "apache", "www apache org licenses", 0.85),
    ("apache-2", "compliance", "you may not use this file except in compliance with the license", 0.9),
    ("apache-2", "limitations", "see the license for the specific language governing permissions and limitations under the license", 0.9),
    ("apache-2", "contributor", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable", 0.95),
    ("apache-2", "apache", "apache license version 2 0 january 2004", 1.0),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation", 0.9),
    ("apache-2", "asf", "licensed to the apache software foundation asf under one or more contributor license agreements", 0.95),
    # reciprocal
    ("gpl", "gnu", "you should have received a copy of the gnu general public license along with", 0.85),
    ("gpl", "gnu", "www gnu org (?:licenses|copyleft) gpl(?: html| txt)?", 0.85),
    ("gpl-2.0", "gnu", "www gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?", 1.0),
    ("gpl-3.0", "gnu", "www gnu org licenses gpl 3 0(?: html| txt| en html)?", 1.0),
    ("gpl-2.0", "june", "gnu general public license version 2 june 1991", 1.0),
    ("gpl-3.0", "june", "gnu general public license version 3 29 june 2007", 1.0),
    ("gpl-2.0", "only", "gnu general public license version 2 only", 1.0),
    ("gpl", "freedom", "the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change", 0.95),
    ("gpl", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", 0.9),
    ("gpl-2.0-classpath", "classpath", "(?:gpl ?v?2(?: 0)? )?with (?:the )?classpath exception", 0.95),
    ("gcc-exception", "gcc", "gcc runtime library exception(?: version 3 1)?", 0.95),
    ("lgpl", "gnu", "www gnu org licenses lgpl(?: html| txt)?", 0.85),
    ("lgpl-2.1", "gnu", "www gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?", 1.0),
    ("lgpl-3.0", "gnu", "www gnu org licenses lgpl 3 0(?: html| txt| en html)?", 1.0),
    ("lgpl-2.0", "library", "gnu library general public license(?: version 2)?(?: june 1991)?", 0.95),
    ("lgpl-2.1", "february", "gnu lesser general public license version 2 1 february 1999", 1.0),
    ("lgpl-2.1+", "either", "either version 2 1 of the license or at your option any later version", 1.0),
    ("agpl-3.0", "affero", "gnu affero general public license version 3 19 november 2007", 1.0),
    ("agpl", "affero", "under the terms of the gnu affero general public license", 0.95),
    ("agpl-3.0", "gnu", "www gnu org licenses agpl(?: 3 0)?(?: html| txt)?", 0.95),
    ("agpl-3.0", "remotely", "interacting with it remotely through a computer network", 0.9),
    ("gfdl", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 1.0),
    ("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts", 0.95),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1", 1.0),
    ("mpl-2.0", "mozilla", "(?:www )?mozilla org mpl 2 0|mozilla org (?:en us )?mpl 2 0", 1.0),
    ("mpl-2.0", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", 1.0),
    ("mpl-1.1", "mozilla", "www mozilla org mpl(?: mpl 1 1 html)?", 0.85),
    ("epl-1.0", "eclipse", "www eclipse org legal epl v10(?: html)?", 1.0),
    ("epl-2.0", "eclipse", "www eclipse org legal epl (?:2 0|v20)(?: html)?", 1.0),
    ("epl-1.0", "eclipse", "made available under the terms of the eclipse public license v1 0", 1.0),
    ("epl-2.0", "eclipse", "made available under the terms of the eclipse public license (?:v )?2 0", 1.0),
    ("edl-1.0", "eclipse", "www eclipse org org documents edl v10(?: php| html)?", 1.0),
    ("cddl-1.0", "cddl development", "subject to the terms of the common development and distribution license the license|glassfish dev java net public cddl", 0.95),
    ("cpl-1.0", "common", "provided under the terms of this common public license", 0.95),
    ("ipl-1.0", "ibm", "provided under the terms of this ibm public license", 0.95),
    ("eupl-1.2", "eupl", "joinup ec europa eu (?:[a-z0-9]+ ){0,6}eupl", 0.95),
    ("eupl-1.2", "eupl", "licensed under the eupl(?: version| v)? 1 2", 1.0),
    ("osl-3.0", "open", "licensed under the open software license version 3 0", 1.0),
    ("cecill-2.1", "cecill", "(?:governed by|under) the cecill(?: 2 1)? license|www cecill info", 0.95),
    ("cecill-b", "cecill", "governed by the cecill b license", 1.0),
    ("cecill-c", "cecill", "governed by the cecill c license", 1.0),
    ("artistic-2.0", "artistic", "(?:www )?(?:perlfoundation org|opensource org licenses) artistic (?:license )?2 0", 1.0),
    ("artistic-1.0", "artistic", "the artistic license preamble the intent of this document", 1.0),
    ("lppl-1.3c", "lppl", "www latex project org lppl(?: txt)?|may be distributed and or modified under the conditions of the latex project public license lppl", 0.95),
    ("sleepycat", "sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code .{0,120}? sleepycat", 0.9),
    ("rpl-1.5", "reciprocal", "reciprocal public license(?: version)? 1 5", 0.95),
    ("nasa-1.3", "nasa", "nasa open source agreement(?: version)? 1 3", 0.95),
    # source available
    ("busl-1.1", "business", "business source license 1 1 .{0,60}? parameters", 1.0),
    ("busl-1.1", "licensor", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", 0.95),
    ("sspl-1.0", "sspl mongodb", "mongodb com licensing server side public license|licensed under the (?:terms of the )?sspl", 0.95),
    ("elastic-2.0", "elastic", "www elastic co licensing elastic license", 1.0),
    ("elastic-2.0", "managed", "you may not provide the software to third parties as a hosted or managed service", 0.9),
    ("commons-clause", "clause", "commons clause license condition v1 0", 1.0),
    ("polyform", "polyformproject", "polyformproject org licenses", 0.95),
    ("confluent-community", "confluent", "confluent community license(?: agreement)?(?: version)?(?: 1 0)?", 0.95),
    ("openrail", "responsible rail openrail", "(?:responsible ai license|open rail m|openrail m)", 0.85),
    ("llama", "llama", "llama (?:2|3|3 1|3 2)? ?community license(?: agreement)?", 0.95),
    ("gemma", "gemma", "gemma terms of use", 0.9),
    # documents, data and fonts
    ("cc-by", "creative", "licensed under a creative commons attribution [1-4] [05](?: international| unported| generic)? license", 1.0),
    ("cc-by-sa", "creative", "licensed under a creative commons attribution share ?alike [1-4] [05](?: international| unported| generic)? license", 1.0),
    ("cc-by-nc", "creative", "licensed under a creative commons attribution non ?commercial [1-4] [05](?: international| unported| generic)? license", 1.0),
    ("cc-by-nd", "creative", "licensed under a creative commons attribution no ?deriv(?:ative)?s [1-4] [05](?: international| unported| generic)? license", 1.0),
    ("cc-by-nc-sa", "creative", "licensed under a creative commons attribution non ?commercial share ?alike [1-4] [05](?: international| unported| generic)? license", 1.0),
    ("cc-by-nc-nd", "creative", "licensed under a creative commons attribution non ?commercial no ?deriv(?:ative)?s [1-4] [05](?: international| unported| generic)? license", 1.0),
    ("cc0-1.0", "waived", "has waived all copyright and related or neighboring rights", 0.95),
    ("cc0-1.0", "cc0", "to the extent possible under law .{1,120}? cc0", 0.95),
    ("cc-pdm", "mark", "creativecommons org publicdomain mark 1 0|public domain mark 1 0", 0.95),
    ("odbl-1.0", "opendatacommons", "opendatacommons org licenses odbl", 1.0),
    ("pddl-1.0", "opendatacommons", "opendatacommons org licenses pddl", 1.0),
    ("odc-by-1.0", "opendatacommons", "opendatacommons org licenses by", 1.0),
    ("cdla-permissive", "cdla", "cdla permissive(?: [12] 0)?|cdla dev permissive", 0.95),
    ("ogl-uk-3.0", "government", "open government licence(?: v| version)?(?: 3 0)?", 0.9),
    ("etalab-2.0", "etalab", "(?:licence ouverte )?etalab(?: 2 0| v2 0)?", 0.8),
    ("ofl-1.1", "sil", "scripts sil org ofl|this font software is licensed under the sil open font license version 1 1", 1.0),
    ("ofl-1.1", "font", "neither the font software nor any of its individual components .{0,60}? may be sold by itself", 0.95),
    ("bitstream-vera", "vera", "bitstream vera is a trademark of bitstream", 0.95),
    ("gust-font", "gust", "gust font license", 0.95),
    # rights that are kept
    ("proprietary", "unauthorized", "unauthorized copying of this file via any medium is strictly prohibited", 0.9),
    ("proprietary", "reproduced", "no part of this (?:publication|book|document|work|website) may be reproduced", 0.7),
    ("proprietary", "permission", "without (?:the )?(?:prior|express|prior express) written permission of (?:the )?(?:publisher|author|copyright (?:holder|owner))", 0.6),
    ("proprietary", "trade", "contains (?:proprietary|confidential) (?:information and )?trade secrets", 0.7),
    ("proprietary", "evaluation", "licensed for evaluation purposes only", 0.8),
    ("proprietary", "personal", "for personal(?: and| or)? non ?commercial use only", 0.6),
    ("proprietary", "reverse", "you may not reverse engineer decompile or disassemble", 0.7),
    ("eula", "eula user", "end user license agreement(?: eula)?|eula", 0.6),
    ("us-government", "government", "(?:this is a work of the|work of the) (?:u s|united states) government", 0.8),
    ("us-government", "rights", "u s government restricted rights", 0.8),
    ("no-license", "license", "no license (?:is granted|express or implied)", 0.5),
    # mentions
    ("gpl", "general", f"(?:gnu )?general public {_LICENSE}", 0.6),
    ("lgpl", "lesser", f"(?:gnu )?lesser general public {_LICENSE}", 0.6),
    ("apache", "apache", f"apache {_LICENSE}", 0.6),
    ("bsd", "bsd", f"bsd(?: style)? {_LICENSE}", 0.6),
    ("creative-commons", "creative", f"creative commons(?: {_LICENSE})?", 0.5),
    ("public-domain", "domain", "(?:placed in|released into|dedicated to) the public domain", 0.7),
    ("proprietary", "rights", "all rights reserved", 0.3),
    ("proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary)", 0.5),
)


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    keywords: tuple[bytes, ...]
    pattern: re.Pattern
    score: float


def rules() -> list[Rule]:
    """All rules in order: tags, whole passages, notices, plain mentions of a name with the word license."""
    raw: list[tuple[str, str, str, float]] = []
    raw += [(label, "spdx", f"spdx license identifier {tag}", 1.0) for label, _, tag, _ in FAMILIES]
    raw += [p for p in PASSAGES if p[3] >= 0.8]
    raw += [(label, key, f"(?:licen[cs]ed|released|distributed|available|provided)(?: \\w+)? under (?:the )?(?:terms of (?:the )?)?(?:{name})(?: {_LICENSE})?", 0.95) for label, key, _, name in FAMILIES]
    raw += [(label, key, f"(?:{name}) {_LICENSE}", 0.8) for label, key, _, name in FAMILIES]
    raw += [(label, key, f"{_LICENSE} (?:is |type )?(?:{tag}|{name})", 0.75) for label, key, tag, name in FAMILIES]
    raw += [p for p in PASSAGES if p[3] < 0.8]
    raw += [(label, phrase.split()[-1] if label != "cc-by-nc" else "nc", phrase, 0.9) for phrase, label in BASE]
    return [Rule(i, label, tuple(key.encode().split()), re.compile(rb"(?<![^ ])(?:" + text.encode() + rb")(?![^ ])"), score) for i, (label, key, text, score) in enumerate(raw)]


def suppressed(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Without detections inside another one; of equal intervals, and of two that overlap in part, the first rule stays.

    Sorted by start, longest first, an interval lies in an earlier one exactly if it ends no later
    than the furthest end so far. What is left has rising starts and ends; in the order of the rules
    each of these stays unless it overlaps one that has stayed.
    """
    outer, reach = [], -1
    for a, b, rule in sorted(found, key=lambda d: (d[0], -d[1], d[2].priority)):
        if b > reach:
            outer.append((a, b, rule))
            reach = b
    stay: list[tuple[int, int, Rule]] = []
    for d in sorted(outer, key=lambda d: (d[2].priority, d[0])):
        at = bisect_left(stay, d[0], key=lambda s: s[0])
        if (at == 0 or stay[at - 1][1] <= d[0]) and (at == len(stay) or stay[at][0] >= d[1]):
            stay.insert(at, d)
    return stay


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every whole text.

    Words are runs of ASCII letters and digits and non-ASCII characters after lower-casing A-Z.
    labels: those of the detections that stay, and the base labels, distinct, sorted, comma-joined;
    score: the largest score of a detection, 0 without one. spans: (label, first word, words, score).
    Null counts as empty; a null doc_id stays null; repeated rows are scanned each; other columns
    aren't looked at. Empty in, empty out.
    """
    span = pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("score", pa.float64())])
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = rules()
        by_key: dict[bytes, list[Rule]] = {}
        for r in ordered:
            for key in r.keywords:
                by_key.setdefault(key, []).append(r)
        longest = max(map(len, by_key))
        gate = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + b"|".join(sorted(map(re.escape, by_key), key=lambda k: -len(k))) + rb")(?![0-9a-z\x80-\xff])")
        assert longest < 64
        base = [(re.compile(rb"(?<![^ ])(?=" + p.encode() + rb"(?![^ ]))"), label) for p, label in BASE]
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for _, _, data, offsets in chunks(strings(batch.column(1))):
                words = Words(data, offsets)
                lower = LOWER[data].tobytes()
                for i in range(len(offsets) - 1):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    row = [b - a, 0, None, None, "", "", 0.0, []]
                    keys = set(gate.findall(lower[int(offsets[i]) : int(offsets[i + 1])]))  # a slice: a look behind would see the text before
                    if keys:
                        row[1:] = _detect(lower, words, a, b, keys, by_key, base)
                    for c, x in zip(columns[1:], row, strict=True):
                        c.append(x)
            columns[0] = batch.column(0).to_pylist()
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, word: long, words: long, score: double>>"
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _detect(lower: bytes, words: Words, a: int, b: int, keys: set[bytes], by_key: dict, base: list) -> list:
    own = [lower[s:e] for s, e in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist(), strict=True)]
    joined = b" ".join(own)
    begins = np.cumsum([0] + [len(w) + 1 for w in own])
    word_at = lambda place: int(np.searchsorted(begins, place, "right")) - 1
    places, base_labels = [], set()
    for pattern, label in base:
        hits = [word_at(m.start()) for m in pattern.finditer(joined)]
        places += hits
        if hits:
            base_labels.add(label)
    found = [(m.start(), m.end(), r) for r in {r.priority: r for k in keys for r in by_key[k]}.values() for m in r.pattern.finditer(joined)]
    stay = suppressed(found)
    spans = [{"label": r.label, "word": word_at(s), "words": word_at(e - 1) - word_at(s) + 1, "score": r.score} for s, e, r in stay]
    labels = base_labels | {r.label for _, _, r in stay}
    score = max([x["score"] for x in spans], default=0.9 if base_labels else 0.0)
    return [len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), float(score), spans]
