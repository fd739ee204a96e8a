"""License scans by ordered signature rules.

Rules are regexes over the normal form of a text: A-Z lower-cased, words joined by single spaces. They come from two
places: signatures written one by one (permission notices, conditions, disclaimers, headers and addresses of each license) and a table of licenses that is put
into phrase templates ("licensed under ...", "SPDX-License-Identifier: ..."). Each rule has a label, a priority, a confidence and a keyword.
All keywords are looked for in one pass; a text is searched by a rule only if it holds the rule's keyword.

Overlaps are resolved in order of priority, then length, then place: a detection goes if its interval is contained in one that was
kept before it. Base phrases are found apart from that and always stay.

Scale. Documents are only mapped; the rules are a constant of the program.

Defined results. Null counts as empty: no words, no places, empty labels, score 0. Repeated rows stay, an empty table
gives no rows, columns other than doc_id and text are ignored. Texts of any length are scanned whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.common import WORD_BYTES, by_batch, raw

#: Fixed by the contract: phrase and label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, SPDX identifier in words, names of the license in words (a regex each).
LICENSES = (
    ("mit", "mit", ("mit", "expat")),
    ("mit-0", "mit 0", ("mit no attribution",)),
    ("apache", "apache 2 0", ("apache", "apache software", "asl 2 0")),
    ("apache-1.1", "apache 1 1", ("apache software license 1 1",)),
    ("gpl", "gpl", ("gnu gpl", "gnu general public", "gpl ?v?[123]", "gplv[123]")),
    ("gpl-2.0", "gpl 2 0", ("gnu general public license (?:version|v) ?2", "gpl ?v?2(?: 0)?")),
    ("gpl-3.0", "gpl 3 0", ("gnu general public license (?:version|v) ?3", "gpl ?v?3(?: 0)?")),
    ("lgpl", "lgpl", ("gnu lesser general public", "gnu library general public", "lgpl")),
    ("agpl", "agpl", ("gnu affero general public", "affero general public", "agpl")),
    ("bsd", "bsd", ("bsd", "berkeley software distribution")),
    ("bsd-2-clause", "bsd 2 clause", ("bsd 2 clause", "simplified bsd", "freebsd")),
    ("bsd-3-clause", "bsd 3 clause", ("bsd 3 clause", "new bsd", "modified bsd", "revised bsd")),
    ("bsd-4-clause", "bsd 4 clause", ("bsd 4 clause", "original bsd")),
    ("0bsd", "0bsd", ("zero clause bsd", "bsd zero clause")),
    ("isc", "isc", ("isc", "internet systems consortium")),
    ("mpl", "mpl", ("mozilla public", "mpl")),
    ("mpl-2.0", "mpl 2 0", ("mozilla public license (?:version|v) ?2(?: 0)?",)),
    ("epl", "epl", ("eclipse public", "epl")),
    ("cddl", "cddl", ("common development and distribution", "cddl")),
    ("cpl", "cpl 1 0", ("common public",)),
    ("eupl", "eupl 1 2", ("european union public", "eupl")),
    ("artistic", "artistic 2 0", ("artistic", "perl artistic")),
    ("zlib", "zlib", ("zlib", "zlib libpng")),
    ("libpng", "libpng", ("libpng", "png reference library")),
    ("boost", "bsl 1 0", ("boost software", "bsl")),
    ("busl", "busl 1 1", ("business source",)),
    ("sspl", "sspl 1 0", ("server side public", "sspl")),
    ("elastic", "elastic 2 0", ("elastic", "elastic license 2 0")),
    ("unlicense", "unlicense", ("unlicense",)),
    ("wtfpl", "wtfpl", ("wtfpl", "do what the fuck you want to public")),
    ("psf", "psf 2 0", ("python software foundation", "psf")),
    ("php", "php 3 01", ("php",)),
    ("ruby", "ruby", ("ruby",)),
    ("ofl", "ofl 1 1", ("sil open font", "open font")),
    ("openssl", "openssl", ("openssl", "ssleay")),
    ("ms-pl", "ms pl", ("microsoft public",)),
    ("ms-rl", "ms rl", ("microsoft reciprocal",)),
    ("ncsa", "ncsa", ("university of illinois ncsa open source", "ncsa")),
    ("upl", "upl 1 0", ("universal permissive",)),
    ("postgresql", "postgresql", ("postgresql",)),
    ("vim", "vim", ("vim",)),
    ("x11", "x11", ("x11", "x consortium")),
    ("curl", "curl", ("curl",)),
    ("gfdl", "gfdl 1 3", ("gnu free documentation", "gfdl")),
    ("odbl", "odbl 1 0", ("open database", "odbl")),
    ("odc-by", "odc by 1 0", ("open data commons attribution",)),
    ("cc0", "cc0 1 0", ("cc0", "creative commons zero", "cc0 1 0 universal")),
    ("cc-by", "cc by 4 0", ("cc by", "creative commons attribution")),
    ("cc-by-sa", "cc by sa 4 0", ("cc by sa", "creative commons attribution share ?alike")),
    ("cc-by-nc", "cc by nc 4 0", ("cc by nc", "creative commons attribution non ?commercial")),
    ("cc-by-nd", "cc by nd 4 0", ("cc by nd", "creative commons attribution no ?derivatives")),
    ("cc-by-nc-sa", "cc by nc sa 4 0", ("cc by nc sa", "creative commons attribution non ?commercial share ?alike")),
    ("cc-by-nc-nd", "cc by nc nd 4 0", ("cc by nc nd", "creative commons attribution non ?commercial no ?derivatives")),
    ("openrail", "openrail", ("openrail", "responsible ai", "openrail m")),
    ("llama", "llama 2", ("llama 2 community", "llama 3 community", "llama community")),
    ("proprietary", "licenseref proprietary", ("proprietary", "commercial")),
)

#: Template, keyword, priority, confidence. NAME and SPDX stand for the table's.
TEMPLATES = (
    (r"spdx license identifier SPDX(?: (?:only|or later))?", "spdx", 90, 1.0),
    (r"licen[sc]ed under (?:the |a )?(?:terms of the )?NAME(?: licen[sc]e)?(?: (?:version |v)?[0-9](?: [0-9])?)?", "licen", 70, 0.95),
    (r"(?:released|distributed|available|published|provided) under (?:the |a )?(?:terms of the )?NAME(?: licen[sc]e)", "licen", 70, 0.9),
    (r"(?:subject to|governed by|terms of) (?:the |a )?NAME licen[sc]e", "licen", 60, 0.85),
    (r"NAME licen[sc]e(?: version)?(?: v?[0-9](?: [0-9])?)?", "licen", 40, 0.7),
    (r"licen[sc]e (?:is |type )?(?:the )?NAME", "licen", 30, 0.5),
)

#: Label, regex, keyword, priority, confidence: notices that name no license.
SIGNATURES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby granted", 80, 0.95),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies", "permission notice", 75, 0.8),
    ("apache", r"you may not use this file except in compliance with the license", "compliance with the license", 80, 0.95),
    ("apache", r"www apache org licenses license 2 0", "apache org licenses", 85, 1.0),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use", 80, 0.95),
    ("bsd-3-clause", r"neither the name of .{1,80}? nor the names of its contributors may be used", "names of its contributors", 82, 0.95),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", "advertising materials mentioning", 83, 0.95),
    ("gpl", r"this program is free software you can redistribute it and or modify it", "redistribute it", 80, 0.9),
    ("gpl-3.0", r"either version 3 of the license or at your option any later version", "any later version", 82, 0.9),
    ("gpl-2.0", r"either version 2 of the license or at your option any later version", "any later version", 82, 0.9),
    ("lgpl", r"this library is free software you can redistribute it and or modify it", "redistribute it", 80, 0.9),
    ("gpl", r"www gnu org licenses gpl", "gnu org licenses", 85, 0.95),
    ("lgpl", r"www gnu org licenses lgpl", "gnu org licenses", 85, 0.95),
    ("agpl", r"www gnu org licenses agpl", "gnu org licenses", 85, 0.95),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission to use", 80, 0.9),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license", "source code form", 85, 0.95),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered software", 85, 0.95),
    ("zlib", r"altered source versions must be plainly marked as such", "altered source versions", 80, 0.9),
    ("boost", r"permission is hereby granted free of charge to any person or organization obtaining", "hereby granted", 81, 0.95),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain", 60, 0.8),
    ("cc", r"creativecommons org licenses", "creativecommons org", 50, 0.8),
    ("cc0", r"creativecommons org publicdomain zero", "creativecommons org", 85, 1.0),
    ("all-rights-reserved", r"all rights reserved", "all rights reserved", 20, 0.6),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", "copyright", 10, 0.3),
    # Permission notices and conditions of short licenses.
    ("mit", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell", "without restriction", 78, 0.9),
    ("mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "warranty of any kind", 40, 0.6),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", "copyright holders be liable", 40, 0.6),
    ("mit", r"opensource org licen[sc]es mit", "opensource org", 85, 1.0),
    ("mit-0", r"to deal in the software without restriction .{1,300}? to permit persons to whom the software is furnished to do so the software is provided", "furnished to do so", 79, 0.9),
    ("mit-0", r"github com aws mit 0", "mit 0", 85, 0.95),
    ("x11", r"except as contained in this notice the name of .{1,80}? shall not be used in advertising or otherwise to promote the sale", "contained in this notice", 84, 0.95),
    ("x11", r"x window system is a trademark of", "x window system", 70, 0.8),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use", 81, 0.85),
    ("curl", r"daniel stenberg", "daniel stenberg", 60, 0.7),
    ("isc", r"the software is provided as is and the author disclaims all warranties with regard to this software", "author disclaims", 76, 0.85),
    ("isc", r"whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance", "tortious action", 72, 0.75),
    ("isc", r"isc disclaims all warranties", "isc disclaims", 80, 0.9),
    ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", "hereby granted the software", 84, 0.9),
    ("bsd", r"redistributions of source code must retain the above copyright notice this list of conditions", "redistributions of source", 78, 0.9),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions in binary", 78, 0.9),
    ("bsd", r"this software is provided by the (?:copyright holders|regents|author|authors) and contributors as is", "is provided by the", 60, 0.7),
    ("bsd", r"however caused and on any theory of liability whether in contract strict liability or tort", "theory of liability", 50, 0.6),
    ("bsd-2-clause", r"the views and conclusions contained in the software and documentation are those of the authors", "views and conclusions", 80, 0.9),
    ("bsd-2-clause", r"opensource org licen[sc]es bsd 2 clause", "opensource org", 86, 1.0),
    ("bsd-3-clause", r"opensource org licen[sc]es bsd 3 clause", "opensource org", 86, 1.0),
    ("bsd-3-clause", r"the names? of .{1,80}? may not be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote", 82, 0.9),
    ("bsd-4-clause", r"this product includes software developed by the university of california berkeley", "university of california", 83, 0.95),
    ("bsd-4-clause", r"the regents of the university of california all rights reserved", "regents of the university", 70, 0.7),
    ("zlib", r"in no event will the authors be held liable for any damages arising from the use of this software", "authors be held liable", 78, 0.85),
    ("zlib", r"the origin of this software must not be misrepresented", "must not be misrepresented", 80, 0.95),
    ("zlib", r"this notice may not be removed or altered from any source distribution", "removed or altered", 74, 0.8),
    ("libpng", r"png reference library is supplied as is", "png reference library", 85, 0.95),
    ("libpng", r"the origin of this source code must not be misrepresented", "source code must not be misrepresented", 83, 0.9),
    ("libpng", r"contributing authors and group 42 inc disclaim all warranties", "group 42 inc", 85, 0.95),
    ("boost", r"www boost org license 1 0", "boost org", 86, 1.0),
    ("boost", r"must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies", "derivative works of the software", 80, 0.9),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to", 85, 0.95),
    ("unlicense", r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest", "recognize copyright laws", 84, 0.95),
    ("unlicense", r"unlicense org", "unlicense org", 84, 0.95),
    ("wtfpl", r"you just do what the fuck you want to", "what the fuck", 86, 0.98),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document", "verbatim or modified", 80, 0.85),
    ("wtfpl", r"www wtfpl net", "wtfpl net", 86, 1.0),
    ("postgresql", r"in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages", "university of california", 82, 0.85),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "without a written agreement", 84, 0.95),
    ("postgresql", r"postgresql database management system formerly known as postgres", "known as postgres", 84, 0.95),
    ("vim", r"vim is charityware", "charityware", 85, 0.95),
    ("vim", r"there are no restrictions on distributing unmodified copies of vim", "copies of vim", 85, 0.98),
    ("ncsa", r"developed by .{1,120}? permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction", "to deal with the software", 83, 0.9),
    ("ncsa", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers", "following disclaimers", 82, 0.9),
    ("upl", r"a copy of any software and or associated documentation and or data files .{1,80}? free of charge and under any and all copyright rights in the software and any and all patent rights", "all patent rights", 84, 0.95),
    ("upl", r"larger works? .{1,80}? to make use sell offer for sale import export have made and have sold the software and the larger works", "larger works", 83, 0.9),
    ("upl", r"oss oracle com licenses upl", "oracle com licenses", 86, 1.0),
    # The Apache family.
    ("apache", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "agreed to in writing", 76, 0.9),
    ("apache", r"licensed to the apache software foundation asf under one or more contributor license agreements", "contributor license agreements", 82, 0.95),
    ("apache", r"subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "each contributor hereby grants", 80, 0.9),
    ("apache", r"you must cause any modified files to carry prominent notices stating that you changed the files", "carry prominent notices", 72, 0.8),
    ("apache", r"if the work includes a notice text file as part of its distribution", "notice text file", 78, 0.85),
    ("apache", r"terms and conditions for use reproduction and distribution 1 definitions license shall mean the terms", "license shall mean", 80, 0.9),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "apache software foundation", 83, 0.9),
    ("apache-1.1", r"the names? apache (?:server|software foundation|group)?.{0,60}? must not be used to endorse or promote products derived", "must not be used to endorse", 84, 0.9),
    ("apache-1.1", r"products derived from this software may not be called apache", "may not be called apache", 84, 0.95),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", "openssl toolkit", 86, 0.98),
    ("openssl", r"this product includes cryptographic software written by eric young", "eric young", 86, 0.98),
    ("openssl", r"products derived from this software may not be called openssl", "may not be called openssl", 86, 0.98),
    ("php", r"this product includes php software freely available from", "php software", 86, 0.98),
    ("php", r"products derived from this software may not be called php", "may not be called php", 86, 0.95),
    ("php", r"www php net license", "php net license", 86, 1.0),
    ("psf", r"this license agreement is between the python software foundation", "python software foundation", 85, 0.98),
    ("psf", r"psf hereby grants licensee a nonexclusive royalty free world wide license", "psf hereby grants", 85, 0.98),
    ("psf", r"psf is making python available to licensee on an as is basis", "making python available", 85, 0.98),
    ("psf", r"cnri hereby grants licensee a nonexclusive royalty free", "cnri hereby grants", 82, 0.9),
    ("ruby", r"you may make and give away verbatim copies of the source form of the software without restriction", "give away verbatim copies", 80, 0.85),
    ("ruby", r"for the list of those files and their copying conditions see the file legal", "copying conditions", 82, 0.9),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied", "a package may be copied", 84, 0.95),
    ("artistic", r"this license establishes the terms under which a given free software package may be copied modified distributed", "given free software package", 85, 0.98),
    ("artistic", r"such that the copyright holder maintains some semblance of artistic control", "artistic control", 84, 0.95),
    ("artistic", r"you may otherwise modify your copy of this package in any way provided that you insert a prominent notice", "copy of this package", 80, 0.9),
    # The GPL family.
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "verbatim copies of this license", 70, 0.8),
    ("gpl", r"the licenses for most software (?:and other practical works )?are designed to take away your freedom to share", "freedom to share", 82, 0.95),
    ("gpl", r"this program is distributed in the hope that it will be useful but without any warranty", "in the hope that", 74, 0.85),
    ("gpl", r"you should have received a copy of the gnu general public license", "received a copy of the gnu", 76, 0.9),
    ("gpl", r"free software foundation inc (?:59 temple place|51 franklin st(?:reet)?)", "free software foundation", 60, 0.7),
    ("gpl-2.0", r"activities other than copying distribution and modification are not covered by this license", "copying distribution and modification", 82, 0.9),
    ("gpl-2.0", r"gnu general public license version 2 june 1991", "june 1991", 86, 1.0),
    ("gpl-2.0", r"you may copy and distribute verbatim copies of the program s source code as you receive it", "verbatim copies of the program", 80, 0.85),
    ("gpl-3.0", r"gnu general public license version 3 29 june 2007", "29 june 2007", 86, 1.0),
    ("gpl-3.0", r"no covered work shall be deemed part of an effective technological measure", "technological measure", 82, 0.9),
    ("gpl-3.0", r"to propagate a work means to do anything with it that without permission would make you", "to propagate a work", 82, 0.9),
    ("gpl-3.0", r"installation information for a user product means any methods", "installation information", 80, 0.85),
    ("lgpl", r"gnu (?:lesser|library) general public license version 2(?: 1)? (?:february 1999|june 1991)", "public license version 2", 86, 1.0),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license", "received a copy of the gnu", 78, 0.92),
    ("lgpl", r"a program that contains no derivative of any portion of the library but is designed to work with the library", "designed to work with the library", 82, 0.9),
    ("lgpl", r"the application together with the combined work|convey a combined work under terms of your choice", "combined work", 78, 0.8),
    ("agpl", r"gnu affero general public license version 3 19 november 2007", "19 november 2007", 86, 1.0),
    ("agpl", r"your modified version must prominently offer all users interacting with it remotely through a computer network", "interacting with it remotely", 84, 0.95),
    ("agpl", r"you should have received a copy of the gnu affero general public license", "received a copy of the gnu", 80, 0.95),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "free documentation license", 86, 0.98),
    ("gfdl", r"with no invariant sections no front cover texts and no back cover texts", "invariant sections", 84, 0.95),
    ("gfdl", r"a secondary section is a named appendix or a front matter section", "secondary section", 82, 0.9),
    ("sspl", r"if you make the functionality of the program or a modified version available to third parties as a service", "third parties as a service", 85, 0.98),
    ("sspl", r"server side public license version 1 october 16 2018", "october 16 2018", 86, 1.0),
    # Weak copyleft with a file or a module as its unit.
    ("mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at", "copy of the mpl", 86, 0.98),
    ("mpl", r"www mozilla org mpl", "mozilla org mpl", 85, 1.0),
    ("mpl", r"the contents of this file are subject to the mozilla public license version", "contents of this file", 85, 0.98),
    ("mpl-2.0", r"incompatible with secondary licenses as defined by the mozilla public license", "secondary licenses", 86, 0.95),
    ("mpl-2.0", r"covered software means source code form to which the initial contributor has attached the notice", "covered software means", 85, 0.95),
    ("epl", r"the accompanying program is provided under the terms of this eclipse public license agreement", "eclipse public license", 86, 0.98),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license", "accompanying materials", 85, 0.98),
    ("epl", r"www eclipse org legal epl", "eclipse org legal", 86, 1.0),
    ("epl", r"a contributor may choose to distribute the program in object code form under its own license agreement", "object code form", 74, 0.75),
    ("cpl", r"the accompanying program is provided under the terms of this common public license", "common public license", 85, 0.98),
    ("cpl", r"ibm is the initial agreement steward", "agreement steward", 80, 0.85),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license", "contents of this file", 85, 0.98),
    ("cddl", r"when distributing covered code include this cddl header in each file", "include this cddl header", 86, 1.0),
    ("cddl", r"sun microsystems inc is the initial license steward", "license steward", 80, 0.85),
    ("cddl", r"opensource org licen[sc]es cddl", "opensource org", 86, 1.0),
    ("eupl", r"licensed under the eupl (?:version|v)", "under the eupl", 86, 0.98),
    ("eupl", r"the european union public licence .{0,40}? applies to the work .{0,60}? which is provided under the terms of this licence", "european union public", 86, 0.98),
    ("eupl", r"compatible licences according to article 5 eupl", "compatible licences", 84, 0.95),
    ("ms-pl", r"this license governs use of the accompanying software if you use the software you accept this license", "accompanying software", 80, 0.85),
    ("ms-pl", r"microsoft public license ms pl", "microsoft public license", 86, 1.0),
    ("ms-rl", r"reciprocal grants for any file you distribute that contains code from the software", "reciprocal grants", 86, 0.98),
    ("ms-rl", r"microsoft reciprocal license ms rl", "microsoft reciprocal", 86, 1.0),
    # Source that may be read but not freely used.
    ("busl", r"the business source license this document or the license is not an open source license", "business source license", 86, 0.98),
    ("busl", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", "non production use", 85, 0.98),
    ("busl", r"additional use grant", "additional use grant", 76, 0.8),
    ("busl", r"effective on the change date or the fourth anniversary of the first publicly available distribution", "change date", 85, 0.98),
    ("elastic", r"you may not provide the software to third parties as a hosted or managed service", "hosted or managed service", 86, 0.98),
    ("elastic", r"you may not move change disable or circumvent the license key functionality", "license key functionality", 86, 0.98),
    ("proprietary", r"this software is the confidential and proprietary information of", "confidential and proprietary", 82, 0.9),
    ("proprietary", r"unauthorized (?:copying|use|reproduction|distribution) of (?:this|these) (?:file|files|software|material|program).{0,80}? is strictly prohibited", "strictly prohibited", 82, 0.9),
    ("proprietary", r"you (?:may|shall) not (?:reverse engineer|decompile|disassemble)", "you", 66, 0.7),
    ("proprietary", r"no part of this (?:software|document|publication|work) may be reproduced .{0,120}? without (?:the )?(?:prior )?written (?:permission|consent)", "may be reproduced", 76, 0.8),
    ("proprietary", r"end user licen[sc]e agreement", "end user licen", 64, 0.75),
    ("proprietary", r"by (?:installing|downloading|using|clicking) .{0,80}? you agree to be bound by the terms of this (?:licen[sc]e )?agreement", "agree to be bound", 70, 0.75),
    ("proprietary", r"this software is licensed not sold", "licensed not sold", 78, 0.85),
    ("proprietary", r"all (?:title|right title and interest) .{0,60}? (?:is|are|remains?) (?:retained by|the property of|the sole property of|with)", "title", 50, 0.5),
    # Texts, data, fonts and models.
    ("cc-by", r"creativecommons org licenses by [0-9] 0", "creativecommons org", 86, 1.0),
    ("cc-by-sa", r"creativecommons org licenses by sa [0-9] 0", "creativecommons org", 87, 1.0),
    ("cc-by-nc", r"creativecommons org licenses by nc [0-9] 0", "creativecommons org", 87, 1.0),
    ("cc-by-nd", r"creativecommons org licenses by nd [0-9] 0", "creativecommons org", 87, 1.0),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa [0-9] 0", "creativecommons org", 88, 1.0),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd [0-9] 0", "creativecommons org", 88, 1.0),
    ("cc-by", r"you must give appropriate credit provide a link to the license and indicate if changes were made", "appropriate credit", 70, 0.8),
    ("cc-by-sa", r"if you remix transform or build upon the material you must distribute your contributions under the same license", "under the same license", 74, 0.85),
    ("cc-by-nc", r"you may not use the material for commercial purposes", "commercial purposes", 70, 0.8),
    ("cc-by-nd", r"if you remix transform or build upon the material you may not distribute the modified material", "modified material", 74, 0.85),
    ("cc", r"by exercising the licensed rights .{0,40}? you accept and agree to be bound by the terms and conditions of this creative commons", "creative commons", 78, 0.9),
    ("cc", r"creative commons corporation .{0,20}? is not a law firm and does not provide legal services", "not a law firm", 78, 0.9),
    ("cc", r"some rights reserved", "some rights reserved", 40, 0.5),
    ("cc0", r"no copyright the person who associated a work with this deed has dedicated the work to the public domain", "associated a work", 86, 0.98),
    ("cc0", r"to the greatest extent permitted by but not in contravention of applicable law affirmer hereby overtly fully permanently irrevocably and unconditionally waives", "affirmer hereby", 86, 0.98),
    ("public-domain", r"this (?:work|file|software|code|material) is in the public domain", "public domain", 66, 0.85),
    ("public-domain", r"works? of the (?:u s|united states) government .{0,80}? not subject to (?:domestic )?copyright protection", "copyright protection", 72, 0.85),
    ("public-domain", r"no (?:rights reserved|copyright is claimed)", "no", 50, 0.6),
    ("odbl", r"opendatacommons org licenses odbl", "opendatacommons org", 86, 1.0),
    ("odbl", r"this .{1,60}? is made available under the open database license", "open database license", 86, 0.98),
    ("odbl", r"any rights in individual contents of the database are licensed under the database contents license", "database contents license", 86, 0.98),
    ("odc-by", r"opendatacommons org licenses by", "opendatacommons org", 85, 1.0),
    ("odc-by", r"this .{1,60}? is made available under the open data commons attribution license", "open data commons", 86, 0.98),
    ("ofl", r"this font software is licensed under the sil open font license", "font software", 86, 1.0),
    ("ofl", r"neither the font software nor any of its individual components in original or modified versions may be sold by itself", "sold by itself", 85, 0.98),
    ("ofl", r"no modified version of the font software may use the reserved font name", "reserved font name", 85, 0.98),
    ("ofl", r"scripts sil org ofl", "sil org ofl", 86, 1.0),
    ("openrail", r"you agree not to use the model or derivatives of the model (?:for|in any way|to)", "derivatives of the model", 84, 0.95),
    ("openrail", r"use restrictions .{0,60}? attachment a", "attachment a", 76, 0.8),
    ("openrail", r"bigscience (?:open)?rail", "bigscience", 85, 0.95),
    ("llama", r"llama materials .{0,200}? you will not use the llama materials or any output or results of the llama materials to improve any other large language model", "llama materials", 87, 1.0),
    ("llama", r"llama [0-9](?: [0-9])? is licensed under the llama [0-9](?: [0-9])? community license", "llama", 87, 1.0),
    ("llama", r"greater than 700 million monthly active users", "monthly active users", 84, 0.95),
    ("llama", r"built with (?:meta )?llama", "built with", 60, 0.6),
    # What says that there is a license without saying which.
    ("license-file", r"see (?:the )?(?:file )?(?:license|licence|copying)(?: (?:txt|md|file))? (?:file )?for (?:the )?(?:full )?(?:license|licence|licensing|copyright|details|terms|more|copying)", "see", 30, 0.4),
    ("license-file", r"(?:license|licence) that can be found in the (?:license|licence|copying) file", "can be found in the", 34, 0.5),
    ("license-file", r"(?:is|are) governed by a bsd style license", "bsd style license", 60, 0.8),
    ("all-rights-reserved", r"todos los derechos reservados|tous droits (?:reserves|réservés)|alle rechte vorbehalten", "re", 22, 0.6),
    ("copyright", r"spdx filecopyrighttext", "spdx filecopyrighttext", 30, 0.5),
    ("copyright", r"copyright (?:c )?(?:by )?the .{1,40}? authors", "copyright", 12, 0.3),
)

@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keyword: bytes
    priority: int
    confidence: float
    regex: re.Pattern


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in their order: by priority, then as listed."""
    found = []
    for i, (label, regex, keyword, priority, confidence) in enumerate(SIGNATURES):
        found.append(Rule(f"signature-{i}", label, keyword.encode(), priority, confidence, _compiled(regex)))
    for label, spdx, names in LICENSES:
        for t, (template, keyword, priority, confidence) in enumerate(TEMPLATES):
            if "SPDX" in template:
                found.append(Rule(f"{label}-spdx", label, keyword.encode(), priority, confidence, _compiled(template.replace("SPDX", spdx))))
                continue
            for k, name in enumerate(names):
                word = re.match("[a-z0-9]+", name)[0]
                gate = word.encode() if len(word) > 2 else keyword.encode()
                found.append(Rule(f"{label}-{t}-{k}", label, gate, priority + len(name) // 8, confidence, _compiled(template.replace("NAME", f"(?:{name})"))))
    return tuple(sorted(found, key=lambda r: -r.priority))


def _compiled(regex: str) -> re.Pattern:
    return re.compile(rb"(?<![^ ])(?:" + regex.encode() + rb")(?![^ ])")


@dataclass
class Found:
    start: int  # words from 0
    end: int
    rule: Rule


@cache
def _gates() -> ahocorasick.Automaton:
    """All keywords, each with the numbers of the rules that it gates, to be found in one pass."""
    found: dict[bytes, list[int]] = {}
    for i, rule in enumerate(rules()):
        found.setdefault(rule.keyword, []).append(i)
    gates = ahocorasick.Automaton()
    for keyword, numbers in found.items():
        gates.add_word(keyword.decode(), tuple(numbers))
    gates.make_automaton()
    return gates


def detections(form: bytes) -> list[Found]:
    """What the rules find in a normal form, after suppression, by place."""
    gated = {numbers for _, numbers in _gates().iter(form.decode("utf-8", "replace"))}
    every = rules()
    hits = []
    for i in sorted(i for numbers in gated for i in numbers):
        hits += [(m.start(), m.end(), every[i]) for m in every[i].regex.finditer(form)]
    if not hits:
        return []
    order = sorted(range(len(hits)), key=lambda i: (-hits[i][2].priority, hits[i][0] - hits[i][1], hits[i][0], i))
    starts: list[int] = []  # of the kept intervals that lie in no other: their starts and ends ascend together
    ends: list[int] = []
    kept = []
    for i in order:
        a, b, _ = hits[i]
        at = bisect_right(starts, a)
        if at and ends[at - 1] >= b:
            continue
        first, last = bisect_left(starts, a), bisect_right(ends, b)
        starts[first : max(first, last)] = [a]
        ends[first : max(first, last)] = [b]
        kept.append(i)
    spaces = np.flatnonzero(np.frombuffer(form, np.uint8) == 32)
    at_word = lambda place: int(np.searchsorted(spaces, place))
    out = [Found(at_word(hits[i][0]), at_word(hits[i][1]) + 1, hits[i][2]) for i in kept]
    return sorted(out, key=lambda f: (f.start, f.end))


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """Word place and label of every base phrase."""
    places = []
    at = -1
    while True:
        try:
            at = words.index(b"license", at + 1)
        except ValueError:
            return sorted(places)
        for phrase, label in BASE:
            parts = phrase.encode().split()
            start = at + 1 - len(parts)
            if start >= 0 and words[start : at + 1] == parts:
                places.append((start, label))


SCHEMA = (
    "n_words long, base array<struct<word:long,label:string>>, detections array<struct<start:long,end:long,label:string,"
    "rule:string,confidence:double>>"
)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, base (places of base phrases) and detections (by place, in words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        found_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("rule", pa.string()), ("confidence", pa.float64())]))
        for batch in by_batch(batches):
            counts, base, found = [], [], []
            for text in raw(batch, "text"):
                words = text.translate(WORD_BYTES).split() if text else []
                counts.append(len(words))
                base.append([{"word": w, "label": label} for w, label in base_places(words)])
                found.append(
                    [{"start": f.start, "end": f.end, "label": f.rule.label, "rule": f.rule.name, "confidence": f.rule.confidence} for f in detections(b" ".join(words))]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(base, base_type), pa.array(found, found_type)],
                ["doc_id", "n_words", "base", "detections"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {SCHEMA}")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns. The score is the largest confidence of a detection; a base phrase alone counts 0.7."""
    places = F.transform("base", lambda x: x["word"])
    base = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    own = F.transform("detections", lambda x: x["label"])
    n_base = F.size("base").cast("long")
    return scanned.select(
        "doc_id", "n_words", n_base.alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        F.concat_ws(",", base).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(base, own)))).alias("labels"),
        F.greatest(
            F.coalesce(F.array_max(F.transform("detections", lambda x: x["confidence"])), F.lit(0.0)),
            F.when(n_base > 0, F.lit(0.7)).otherwise(F.lit(0.0)),
        ).alias("score"),
    )
