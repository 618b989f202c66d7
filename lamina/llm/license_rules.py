"""Signature rules for licenses, in order.

A rule is (license, kind, priority, keywords, pattern).  Keywords are lower-case; a rule is tried
only on texts that hold one of them at the start of a word, and its pattern, which matches from the
start of a word, cannot match without it.  In patterns a space
stands for any run of white space.  Kinds, by priority: ``tag`` machine-readable identifiers, ``text`` phrases
of the license itself, ``notice`` grants that name it, ``name`` bare names, ``mark`` ownership lines.
"""

from __future__ import annotations

import re

TAG, TEXT, NOTICE, NAME, MARK = 50, 40, 30, 20, 10

#: (identifier, pattern of the name, keyword of the name)
NAMES: list[tuple[str, str, str]] = [
    ("Apache-2.0", r"apache (?:software )?licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?", "apache"),
    ("Apache-1.1", r"apache (?:software )?licen[sc]e,? (?:version |v\.? ?)?1\.1", "apache"),
    ("Apache-1.0", r"apache (?:software )?licen[sc]e,? (?:version |v\.? ?)?1\.0", "apache"),
    ("MIT", r"(?:mit|expat)(?:/x11)? licen[sc]e", "licen"),
    ("MIT-0", r"mit no attribution(?: licen[sc]e)?", "mit no"),
    ("X11", r"x11 licen[sc]e", "x11"),
    ("ISC", r"isc licen[sc]e", "isc"),
    ("0BSD", r"(?:zero-clause bsd|0-clause bsd|bsd zero clause)(?: licen[sc]e)?", "bsd"),
    ("BSD-1-Clause", r"(?:1|one)[- ]clause bsd(?: licen[sc]e)?", "bsd"),
    ("BSD-2-Clause", r"(?:(?:2|two)[- ]clause bsd|simplified bsd|freebsd)(?: licen[sc]e)", "bsd"),
    ("BSD-3-Clause", r"(?:(?:3|three)[- ]clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)", "bsd"),
    ("BSD-4-Clause", r"(?:(?:4|four)[- ]clause bsd|original bsd)(?: licen[sc]e)", "bsd"),
    ("GPL-1.0", r"(?:gnu )?general public licen[sc]e,? (?:version |v\.? ?)1(?:\.0)?\b", "general public"),
    ("GPL-2.0", r"(?:gnu )?general public licen[sc]e,? (?:version |v\.? ?)2(?:\.0)?\b", "general public"),
    ("GPL-3.0", r"(?:gnu )?general public licen[sc]e,? (?:version |v\.? ?)3(?:\.0)?\b", "general public"),
    ("LGPL-2.0", r"(?:gnu )?library general public licen[sc]e,? (?:version |v\.? ?)2(?:\.0)?\b", "library general"),
    ("LGPL-2.1", r"(?:gnu )?lesser general public licen[sc]e,? (?:version |v\.? ?)2\.1", "lesser"),
    ("LGPL-3.0", r"(?:gnu )?lesser general public licen[sc]e,? (?:version |v\.? ?)3(?:\.0)?\b", "lesser"),
    ("AGPL-3.0", r"(?:gnu )?affero general public licen[sc]e,? (?:version |v\.? ?)3(?:\.0)?\b", "affero"),
    ("AGPL-1.0", r"affero general public licen[sc]e,? (?:version |v\.? ?)1(?:\.0)?\b", "affero"),
    ("GFDL-1.1", r"gnu free documentation licen[sc]e,? (?:version |v\.? ?)1\.1", "free documentation"),
    ("GFDL-1.2", r"gnu free documentation licen[sc]e,? (?:version |v\.? ?)1\.2", "free documentation"),
    ("GFDL-1.3", r"gnu free documentation licen[sc]e,? (?:version |v\.? ?)1\.3", "free documentation"),
    ("MPL-1.0", r"mozilla public licen[sc]e,? (?:version |v\.? ?)1\.0", "mozilla"),
    ("MPL-1.1", r"mozilla public licen[sc]e,? (?:version |v\.? ?)1\.1", "mozilla"),
    ("MPL-2.0", r"mozilla public licen[sc]e,? (?:version |v\.? ?)2(?:\.0)?\b", "mozilla"),
    ("EPL-1.0", r"eclipse public licen[sc]e(?: -|,)? (?:version |v\.? ?)1(?:\.0)?\b", "eclipse"),
    ("EPL-2.0", r"eclipse public licen[sc]e(?: -|,)? (?:version |v\.? ?)2(?:\.0)?\b", "eclipse"),
    ("EDL-1.0", r"eclipse distribution licen[sc]e", "eclipse"),
    ("CDDL-1.0", r"common development and distribution licen[sc]e(?:,? (?:version |v\.? ?)1\.0)?", "common development"),
    ("CDDL-1.1", r"common development and distribution licen[sc]e,? (?:version |v\.? ?)1\.1", "common development"),
    ("CPL-1.0", r"common public licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)?", "common public"),
    ("EUPL-1.1", r"european union public licen[sc]e,? (?:version |v\.? ?)1\.1", "european union"),
    ("EUPL-1.2", r"european union public licen[sc]e,? (?:version |v\.? ?)1\.2", "european union"),
    ("CECILL-2.1", r"cecill(?: free software)? licen[sc]e(?: agreement)?", "cecill"),
    ("Artistic-1.0", r"artistic licen[sc]e,? (?:version |v\.? ?)?1\.0", "artistic"),
    ("Artistic-2.0", r"artistic licen[sc]e,? (?:version |v\.? ?)?2\.0", "artistic"),
    ("BSL-1.0", r"boost software licen[sc]e", "boost"),
    ("Zlib", r"zlib(?:/libpng)? licen[sc]e", "zlib"),
    ("Libpng", r"libpng licen[sc]e", "libpng"),
    ("Unlicense", r"(?:the )unlicen[sc]e", "unlicen"),
    ("WTFPL", r"do what the f\S+ you want to public licen[sc]e|wtfpl", "public licen|wtfpl"),
    ("PSF-2.0", r"python software foundation licen[sc]e|psf licen[sc]e", "python software|psf"),
    ("Ruby", r"ruby(?:'s)? licen[sc]e", "ruby"),
    ("PHP-3.01", r"php licen[sc]e,? (?:version |v\.? ?)?3\.01", "php"),
    ("PostgreSQL", r"postgresql licen[sc]e", "postgresql"),
    ("OpenSSL", r"openssl licen[sc]e", "openssl"),
    ("NCSA", r"university of illinois(?:/ncsa)? open source licen[sc]e", "illinois"),
    ("AFL-3.0", r"academic free licen[sc]e(?:,? (?:version |v\.? ?)?3\.0)?", "academic free"),
    ("OSL-3.0", r"open software licen[sc]e(?:,? (?:version |v\.? ?)?3\.0)?", "open software"),
    ("OFL-1.1", r"sil open font licen[sc]e(?:,? (?:version |v\.? ?)?1\.1)?", "open font"),
    ("MS-PL", r"microsoft public licen[sc]e", "microsoft"),
    ("MS-RL", r"microsoft reciprocal licen[sc]e", "microsoft"),
    ("UPL-1.0", r"universal permissive licen[sc]e", "universal permissive"),
    ("MulanPSL-2.0", r"mulan (?:psl|permissive software licen[sc]e)", "mulan"),
    ("SSPL-1.0", r"server side public licen[sc]e", "server side"),
    ("BUSL-1.1", r"business source licen[sc]e(?: 1\.1)?", "business source"),
    ("Elastic-2.0", r"elastic licen[sc]e(?: 2\.0)?", "elastic"),
    ("ODbL-1.0", r"open database licen[sc]e|odbl", "open database|odbl"),
    ("ODC-By-1.0", r"open data commons attribution licen[sc]e", "open data commons"),
    ("PDDL-1.0", r"public domain dedication and licen[sc]e", "public domain"),
    ("OGL-UK-3.0", r"open government licen[sc]e(?: v3\.0)?", "open government"),
    ("Vim", r"vim licen[sc]e", "vim"),
    ("Sleepycat", r"sleepycat licen[sc]e", "sleepycat"),
    ("W3C", r"w3c(?: software)?(?: notice and)? licen[sc]e", "w3c"),
    ("Beerware", r"beer-?ware licen[sc]e", "beer"),
    ("CC0-1.0", r"cc0(?: 1\.0)?(?: universal)?|creative commons zero", "cc0|commons zero"),
    ("CC-BY-2.0", r"cc[ -]by[ -]2\.0|creative commons attribution 2\.0", "cc by|cc-by|creative commons"),
    ("CC-BY-2.5", r"cc[ -]by[ -]2\.5|creative commons attribution 2\.5", "cc by|cc-by|creative commons"),
    ("CC-BY-3.0", r"cc[ -]by[ -]3\.0|creative commons attribution 3\.0", "cc by|cc-by|creative commons"),
    ("CC-BY-4.0", r"cc[ -]by[ -]4\.0|creative commons attribution 4\.0", "cc by|cc-by|creative commons"),
    ("CC-BY-SA-2.0", r"cc[ -]by-sa[ -]2\.0|creative commons attribution[- ]share-?alike 2\.0", "cc by|cc-by|creative commons"),
    ("CC-BY-SA-3.0", r"cc[ -]by-sa[ -]3\.0|creative commons attribution[- ]share-?alike 3\.0", "cc by|cc-by|creative commons"),
    ("CC-BY-SA-4.0", r"cc[ -]by-sa[ -]4\.0|creative commons attribution[- ]share-?alike 4\.0", "cc by|cc-by|creative commons"),
    ("CC-BY-ND-3.0", r"cc[ -]by-nd[ -]3\.0|creative commons attribution[- ]no-?deriv\w* 3\.0", "cc by|cc-by|creative commons"),
    ("CC-BY-ND-4.0", r"cc[ -]by-nd[ -]4\.0|creative commons attribution[- ]no-?deriv\w* 4\.0", "cc by|cc-by|creative commons"),
    ("CC-BY-NC-2.0", r"cc[ -]by-nc[ -]2\.0|creative commons attribution[- ]non-?commercial 2\.0", "cc by|cc-by|creative commons"),
    ("CC-BY-NC-3.0", r"cc[ -]by-nc[ -]3\.0|creative commons attribution[- ]non-?commercial 3\.0", "cc by|cc-by|creative commons"),
    ("CC-BY-NC-4.0", r"cc[ -]by-nc[ -]4\.0|creative commons attribution[- ]non-?commercial 4\.0", "cc by|cc-by|creative commons"),
    ("CC-BY-NC-SA-3.0", r"cc[ -]by-nc-sa[ -]3\.0|creative commons attribution[- ]non-?commercial[- ]share-?alike 3\.0", "cc by|cc-by|creative commons"),
    ("CC-BY-NC-SA-4.0", r"cc[ -]by-nc-sa[ -]4\.0|creative commons attribution[- ]non-?commercial[- ]share-?alike 4\.0", "cc by|cc-by|creative commons"),
    ("CC-BY-NC-ND-3.0", r"cc[ -]by-nc-nd[ -]3\.0|creative commons attribution[- ]non-?commercial[- ]no-?deriv\w* 3\.0", "cc by|cc-by|creative commons"),
    ("CC-BY-NC-ND-4.0", r"cc[ -]by-nc-nd[ -]4\.0|creative commons attribution[- ]non-?commercial[- ]no-?deriv\w* 4\.0", "cc by|cc-by|creative commons"),
]

#: Phrases of license texts, links and ownership lines, written one by one.
TEXTS: list[tuple[str, str, int, str, str]] = [
    ("MIT", "text", TEXT, "permission is hereby granted, free of charge", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "text", TEXT, "the above copyright notice and this permission", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("ISC", "text", TEXT, "permission to use, copy, modify", r"permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("BSD-2-Clause", "text", TEXT, "redistributions of source code", r"redistributions of source code must retain the above copyright notice"),
    ("BSD-2-Clause", "text", TEXT, "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BSD-3-Clause", "text", TEXT + 1, "neither the name", r"neither the name of .{1,120}? nor the names of its contributors may be used to endorse"),
    ("BSD-4-Clause", "text", TEXT + 2, "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("Apache-2.0", "text", TEXT, "licensed under the apache license", r"licensed under the apache license, version 2\.0 \(the [\"“]license[\"”]\)"),
    ("Apache-2.0", "text", TEXT, "you may not use this file except", r"you may not use this file except in compliance with the license"),
    ("Apache-2.0", "text", TEXT, "apache.org/licenses", r"https?://www\.apache\.org/licenses/license-2\.0(?:\.txt|\.html)?"),
    ("GPL-2.0-or-later", "text", TEXT + 2, "either version 2", r"either version 2 of the license, or \(at your option\) any later version"),
    ("GPL-3.0-or-later", "text", TEXT + 2, "either version 3", r"either version 3 of the license, or \(at your option\) any later version"),
    ("LGPL-2.1-or-later", "text", TEXT + 2, "either version 2.1", r"either version 2\.1 of the license, or \(at your option\) any later version"),
    ("GPL-2.0", "text", TEXT, "free software; you can redistribute", r"this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("GPL-3.0", "text", TEXT, "free software: you can redistribute", r"this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("LGPL-2.1", "text", TEXT, "this library is free software", r"this library is free software[;:] you can redistribute it and/or modify it under the terms of the gnu lesser general public license"),
    ("GPL", "text", TEXT - 2, "gnu.org/licenses", r"https?://www\.gnu\.org/licenses/(?:old-licenses/)?gpl(?:-[123]\.0)?(?:\.\w+)?"),
    ("LGPL", "text", TEXT - 2, "gnu.org/licenses", r"https?://www\.gnu\.org/licenses/(?:old-licenses/)?lgpl(?:-[23]\.[01])?(?:\.\w+)?"),
    ("AGPL-3.0", "text", TEXT - 2, "gnu.org/licenses", r"https?://www\.gnu\.org/licenses/agpl(?:-3\.0)?(?:\.\w+)?"),
    ("MPL-2.0", "text", TEXT, "mozilla public license", r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0"),
    ("MPL-2.0", "text", TEXT - 2, "mozilla.org/mpl", r"https?://(?:www\.)?mozilla\.org/mpl/2\.0/?"),
    ("EPL-1.0", "text", TEXT, "eclipse.org/legal", r"https?://www\.eclipse\.org/legal/epl-v10\.html"),
    ("EPL-2.0", "text", TEXT, "eclipse.org/legal", r"https?://www\.eclipse\.org/legal/epl-2\.0/?"),
    ("Unlicense", "text", TEXT, "unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("WTFPL", "text", TEXT, "just do what the", r"you just do what the f\S+ you want to"),
    ("Zlib", "text", TEXT, "without any express or implied warranty", r"this software is provided 'as-is', without any express or implied warranty\. in no event will the authors be held liable"),
    ("BSL-1.0", "text", TEXT, "boost.org/license", r"https?://www\.boost\.org/license_1_0\.txt"),
    ("CC0-1.0", "text", TEXT, "creativecommons.org", r"https?://creativecommons\.org/publicdomain/zero/1\.0/?"),
    ("CC-BY-4.0", "text", TEXT, "creativecommons.org", r"https?://creativecommons\.org/licenses/by/4\.0/?"),
    ("CC-BY-3.0", "text", TEXT, "creativecommons.org", r"https?://creativecommons\.org/licenses/by/3\.0/?"),
    ("CC-BY-SA-4.0", "text", TEXT, "creativecommons.org", r"https?://creativecommons\.org/licenses/by-sa/4\.0/?"),
    ("CC-BY-SA-3.0", "text", TEXT, "creativecommons.org", r"https?://creativecommons\.org/licenses/by-sa/3\.0/?"),
    ("CC-BY-NC-4.0", "text", TEXT, "creativecommons.org", r"https?://creativecommons\.org/licenses/by-nc/4\.0/?"),
    ("CC-BY-NC-SA-4.0", "text", TEXT, "creativecommons.org", r"https?://creativecommons\.org/licenses/by-nc-sa/4\.0/?"),
    ("CC-BY-ND-4.0", "text", TEXT, "creativecommons.org", r"https?://creativecommons\.org/licenses/by-nd/4\.0/?"),
    ("CC-BY-NC-ND-4.0", "text", TEXT, "creativecommons.org", r"https?://creativecommons\.org/licenses/by-nc-nd/4\.0/?"),
    ("OFL-1.1", "text", TEXT, "scripts.sil.org", r"https?://scripts\.sil\.org/ofl"),
    ("Beerware", "text", TEXT, "buy me a beer", r"you can buy me a beer in return"),
    ("PSF-2.0", "text", TEXT, "python software foundation", r"this license agreement is between the python software foundation"),
    ("OpenSSL", "text", TEXT, "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("CDDL-1.0", "text", TEXT, "common development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("public-domain", "notice", NOTICE, "public domain", r"(?:released|placed|dedicated|is|are) (?:in|into|to) the public domain"),
    ("GPL", "notice", NOTICE - 2, "general public", r"(?:released|licen[sc]ed|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public licen[sc]e"),
    ("LGPL", "notice", NOTICE - 1, "lesser", r"(?:released|licen[sc]ed|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lesser general public licen[sc]e"),
    ("BSD", "notice", NOTICE - 2, "bsd", r"(?:released|licen[sc]ed|distributed|available) under (?:the |a )?bsd(?:-style)? licen[sc]e"),
    ("GPL", "name", NAME - 5, "general public", r"(?:gnu )general public licen[sc]e"),
    ("LGPL", "name", NAME - 4, "lesser", r"(?:gnu )lesser general public licen[sc]e"),
    ("AGPL", "name", NAME - 4, "affero", r"(?:gnu )affero general public licen[sc]e"),
    ("BSD", "name", NAME - 5, "bsd", r"bsd(?:-style)? licen[sc]e"),
    ("Apache", "name", NAME - 5, "apache", r"apache(?: software)? licen[sc]e"),
    ("MPL", "name", NAME - 5, "mozilla", r"mozilla public licen[sc]e"),
    ("CC", "name", NAME - 5, "creative commons", r"creative commons(?: attribution\S*)? licen[sc]e"),
    ("proprietary", "mark", MARK, "all rights reserved", r"all rights reserved"),
    ("proprietary", "mark", MARK + 1, "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "mark", MARK + 1, "unauthorized", r"unauthorized (?:copying|reproduction|distribution|use) .{0,60}?(?:is )?strictly prohibited"),
    ("copyright", "mark", MARK - 5, "copyright", r"copyright (?:\(c\)|©)? ?(?:19|20)\d\d"),
    ("copyright", "mark", MARK - 5, "©", r"© ?(?:19|20)\d\d"),
]

#: Further sentences of license texts, headers and links, written one by one: (identifier, pattern).
PHRASES: list[tuple[str, str]] = [
    ("MIT", r'the software is provided ["“]as is["”], without warranty of any kind, express or implied'),
    ("MIT", r'in no event shall the authors or copyright holders be liable for any claim, damages or other liability'),
    ("MIT", r'to deal in the software without restriction, including without limitation the rights to use, copy, modify'),
    ("MIT", r'this project is licensed under the mit license'),
    ("MIT", r'https?://(?:www\.)?opensource\.org/licenses?/mit(?:-license)?(?:\.php)?'),
    ("MIT-0", r'permission is hereby granted, free of charge, to any person obtaining a copy of this software .{0,120}? without restriction, .{0,220}? to whom the software is furnished to do so\. the software is provided'),
    ("X11", r'except as contained in this notice, the name of .{1,60}? shall not be used in advertising or otherwise to promote the sale'),
    ("X11", r'x consortium shall not be used in advertising'),
    ("ISC", r'permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice'),
    ("ISC", r'the software is provided ["“]as is["”] and the author disclaims all warranties with regard to this software'),
    ("0BSD", r'permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\.'),
    ("HPND", r'permission to use, copy, modify(?:,|\s+and) distribute this software and its documentation for any purpose'),
    ("HPND", r'in supporting documentation, and that the name of .{1,80}? not be used in advertising or publicity'),
    ("BSD-3-Clause", r'the names? of .{1,80}? may not be used to endorse or promote products derived from this software without specific prior written permission'),
    ("BSD-2-Clause", r'this software is provided by the copyright holders and contributors ["“]as is["”]'),
    ("BSD-2-Clause", r'the views and conclusions contained in the software and documentation are those of the authors'),
    ("BSD-3-Clause", r'redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met'),
    ("BSD-3-Clause", r'https?://(?:www\.)?opensource\.org/licenses?/bsd-3-clause'),
    ("BSD-2-Clause", r'https?://(?:www\.)?opensource\.org/licenses?/bsd-2-clause'),
    ("BSD-3-Clause", r'use of this source code is governed by a bsd-style license that can be found in the license file'),
    ("BSD-4-Clause", r'this product includes software developed by the university of california, berkeley and its contributors'),
    ("BSD-3-Clause-Clear", r"""no express or implied licenses to any party's patent rights are granted by this license"""),
    ("BSD-3-Clause-LBNL", r'lawrence berkeley national laboratory hereby grants'),
    ("Apache-2.0", r'unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an'),
    ("Apache-2.0", r'see the license for the specific language governing permissions and limitations under the license'),
    ("Apache-2.0", r'you may obtain a copy of the license at https?://www\.apache\.org'),
    ("Apache-2.0", r'terms and conditions for use, reproduction, and distribution'),
    ("Apache-2.0", r'licensed to the apache software foundation \(asf\) under one or more contributor license agreements'),
    ("Apache-2.0", r'subject to the terms and conditions of this license, each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge'),
    ("Apache-1.1", r'this product includes software developed by the apache software foundation'),
    ("Apache-1.1", r'products derived from this software may not be called ["“]apache["”]'),
    ("GPL-2.0", r'this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public license'),
    ("GPL-2.0", r'you should have received a copy of the gnu general public license along with this program; if not, write to the free software foundation'),
    ("GPL-3.0", r'you should have received a copy of the gnu general public license along with this program\. if not, see'),
    ("GPL-2.0", r'the licenses for most software are designed to take away your freedom to share and change it'),
    ("GPL-3.0", r'the gnu general public license is a free, copyleft license for software and other kinds of works'),
    ("GPL-2.0", r'under the terms of version 2 of the gnu general public license as published'),
    ("GPL-3.0", r'under the terms of version 3 of the gnu general public license as published'),
    ("GPL-2.0-only", r'under the terms and conditions of the gnu general public license,? version 2,? as published by the free software foundation'),
    ("GPL-1.0-or-later", r'either version 1, or \(at your option\) any later version'),
    ("GPL-3.0", r'everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed'),
    ("LGPL-2.1", r'you should have received a copy of the gnu lesser general public license along with this (?:library|program|software)'),
    ("LGPL-2.0", r'you should have received a copy of the gnu library general public license along with this library'),
    ("LGPL-2.0-or-later", r'under the terms of the gnu library general public license as published by the free software foundation; either version 2'),
    ("LGPL-3.0-or-later", r'under the terms of the gnu lesser general public license as published by the free software foundation, either version 3'),
    ("LGPL-3.0", r'this version of the gnu lesser general public license incorporates the terms and conditions of version 3'),
    ("AGPL-3.0", r'you should have received a copy of the gnu affero general public license along with this program'),
    ("AGPL-3.0-or-later", r'under the terms of the gnu affero general public license as published by the free software foundation, either version 3'),
    ("AGPL-3.0", r'the gnu affero general public license is a free, copyleft license'),
    ("AGPL-3.0", r'interacting with it remotely through a computer network'),
    ("GFDL-1.2", r'permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license, version 1\.2'),
    ("GFDL-1.3", r'permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license, version 1\.3'),
    ("GFDL", r'with no invariant sections, no front-cover texts,? and no back-cover texts'),
    ("GPL-2.0-with-classpath-exception", r'linking this library statically or dynamically with other modules is making a combined work based on this library'),
    ("GCC-exception-3.1", r'this file is part of gcc\. .{0,300}? gcc runtime library exception'),
    ("Linux-syscall-note", r'user programs that use kernel services by normal system calls'),
    ("MPL-2.0", r'if a copy of the mpl was not distributed with this file, you can obtain one at'),
    ("MPL-2.0", r'incompatible with secondary licenses["”]?, as defined by the mozilla public license'),
    ("MPL-1.1", r'the contents of this file are subject to the mozilla public license version 1\.1'),
    ("MPL-1.0", r'the contents of this file are subject to the mozilla public license version 1\.0'),
    ("MPL-1.1", r'software distributed under the license is distributed on an ["“]as is["”] basis, without warranty of any kind, either express or implied\. see the license for the specific language governing rights'),
    ("NPL-1.1", r'the contents of this file are subject to the netscape public license'),
    ("EPL-1.0", r'this program and the accompanying materials are made available under the terms of the eclipse public license v1\.0'),
    ("EPL-2.0", r'this program and the accompanying materials are made available under the terms of the eclipse public license 2\.0'),
    ("EPL-2.0", r'this source code may also be made available under the following secondary licenses'),
    ("EDL-1.0", r'the eclipse distribution license is available at'),
    ("CPL-1.0", r'the accompanying program is provided under the terms of this common public license'),
    ("IPL-1.0", r'the accompanying program is provided under the terms of this ibm public license'),
    ("CDDL-1.0", r'you may not use this file except in compliance with the license\. you can obtain a copy of the license at .{0,80}?cddl'),
    ("CDDL-1.1", r'when distributing the software, include this license header notice in each file'),
    ("EUPL-1.2", r'licensed under the eupl,? version 1\.2 or'),
    ("EUPL-1.1", r'licensed under the eupl,? version 1\.1 or'),
    ("CECILL-2.1", r'this software is governed by the cecill license under french law'),
    ("CECILL-B", r'this software is governed by the cecill-b license under french law'),
    ("CECILL-C", r'this software is governed by the cecill-c license under french law'),
    ("Artistic-2.0", r'the intent of this document is to state the conditions under which a package may be copied'),
    ("Artistic-1.0-Perl", r'under the same terms as perl itself'),
    ("Artistic-2.0", r'you are permitted to use, copy and distribute the standard version'),
    ("BSL-1.0", r'distributed under the boost software license, version 1\.0'),
    ("BSL-1.0", r'permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license'),
    ("Zlib", r'this notice may not be removed or altered from any source distribution'),
    ("Zlib", r'the origin of this software must not be misrepresented; you must not claim that you wrote the original software'),
    ("Zlib", r'altered source versions must be plainly marked as such'),
    ("Libpng", r'the png reference library is supplied ["“]as is["”]'),
    ("Unlicense", r'anyone is free to copy, modify, publish, use, compile, sell, or distribute this software'),
    ("Unlicense", r'in jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest'),
    ("Unlicense", r'for more information, please refer to <?https?://unlicense\.org'),
    ("WTFPL", r'everyone is permitted to copy and distribute verbatim or modified copies of this license document'),
    ("PSF-2.0", r'psf is making python available to licensee on an'),
    ("PSF-2.0", r'python software foundation; all rights reserved'),
    ("Ruby", r'you may redistribute it and/or modify it under either the terms of the 2-clause bsdl'),
    ("Ruby", r'ruby is copyrighted free software by'),
    ("PHP-3.01", r'this source file is subject to version 3\.01 of the php license'),
    ("PHP-3.0", r'this source file is subject to version 3\.0 of the php license'),
    ("Zend-2.0", r'this source file is subject to version 2\.00 of the zend license'),
    ("PostgreSQL", r'in no event shall the university of california be liable to any party for direct, indirect, special, incidental, or consequential damages'),
    ("OpenSSL", r'redistributions of any form whatsoever must retain the following acknowledgment'),
    ("SSLeay", r'this product includes cryptographic software written by eric young'),
    ("NCSA", r'permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files .{0,20}?to deal with the software without restriction'),
    ("Apache-2.0-with-LLVM", r'part of the llvm project, under the apache license v2\.0 with llvm exceptions'),
    ("AFL-3.0", r'licensed under the academic free license version 3\.0'),
    ("OSL-3.0", r'licensed under the open software license version 3\.0'),
    ("OFL-1.1", r'this font software is licensed under the sil open font license'),
    ("OFL-1.1", r'the font software may be sold as part of a larger software package'),
    ("MS-PL", r'this license governs use of the accompanying software\. if you use the software, you accept this license'),
    ("UPL-1.0", r'subject to the condition set forth below, permission is hereby granted to any person obtaining a copy of this software, associated documentation and/or data'),
    ("MulanPSL-2.0", r'you can use this software according to the terms and conditions of the mulan psl v2'),
    ("SSPL-1.0", r'offering a service the value of which entirely or primarily derives from the value of the program'),
    ("BUSL-1.1", r'the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use'),
    ("BUSL-1.1", r'on the change date, or the fourth anniversary of the first publicly available distribution'),
    ("Elastic-2.0", r'you may not provide the software to third parties as a hosted or managed service'),
    ("Commons-Clause", r'the software is provided to you by the licensor under the license, as defined below, subject to the following condition'),
    ("PolyForm-Noncommercial-1.0.0", r'any noncommercial purpose is a permitted purpose'),
    ("ODbL-1.0", r'this database is made available under the open database license'),
    ("ODC-By-1.0", r'is made available under the open data commons attribution license'),
    ("PDDL-1.0", r'is made available under the public domain dedication and license'),
    ("CDLA-Permissive-2.0", r'community data license agreement [-–] permissive'),
    ("OGL-UK-3.0", r'contains public sector information licensed under the open government licence'),
    ("OGL-UK-3.0", r'you are free to: copy, publish, distribute and transmit the information'),
    ("CC0-1.0", r'to the extent possible under law, .{1,80}? has waived all copyright and related or neighboring rights'),
    ("CC0-1.0", r'the person who associated a work with this deed has dedicated the work to the public domain'),
    ("CC-BY-4.0", r'this work is licensed under a creative commons attribution 4\.0 international license'),
    ("CC-BY-SA-4.0", r'this work is licensed under a creative commons attribution-sharealike 4\.0 international license'),
    ("CC-BY-NC-4.0", r'this work is licensed under a creative commons attribution-noncommercial 4\.0 international license'),
    ("CC-BY-SA-3.0", r'text is available under the creative commons attribution-sharealike license'),
    ("CC-BY-SA-3.0", r'this work is licensed under the creative commons attribution-sharealike 3\.0 unported license'),
    ("CC-BY-4.0", r'by exercising the licensed rights .{0,30}?you accept and agree to be bound by the terms and conditions of this creative commons attribution 4\.0'),
    ("W3C", r'by obtaining, using and/or copying this work, you .{0,20}?agree that you have read, understood, and will comply'),
    ("Vim", r'there are no restrictions on distributing unmodified copies of vim'),
    ("Sleepycat", r'redistributions in any form must be accompanied by information on how to obtain complete source code for'),
    ("Info-ZIP", r'for the purposes of this copyright and license, ["“]info-zip["”] is defined as'),
    ("JSON", r'the software shall be used for good, not evil'),
    ("curl", r'permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies'),
    ("Unicode-DFS-2016", r'distribution of the unicode data files and any associated documentation'),
    ("ICU", r'permission is hereby granted, free of charge, .{0,120}? provided that the above copyright notice\(s\) and this permission notice appear'),
    ("TCL", r'the authors hereby grant permission to use, copy, modify, distribute, and license this software'),
    ("FTL", r'portions of this software are copyright .{0,60}? the freetype project'),
    ("IJG", r'this software is based in part on the work of the independent jpeg group'),
    ("Bitstream-Vera", r'the font software may be modified, altered, or added to, and in particular the designs of glyphs'),
    ("blessing", r'may you do good and not evil\. may you find forgiveness for yourself and forgive others'),
    ("MirOS", r'provided that these terms and disclaimer and all copyright notices are retained or reproduced in an accompanying document'),
    ("NAIST-2003", r'use, reproduction, and distribution of this software is permitted'),
    ("Intel", r'neither the name of intel corporation nor the names of its contributors'),
    ("NIST-PD", r'this software was developed at the national institute of standards and technology by employees of the federal government'),
    ("public-domain", r'this work is in the public domain in the united states'),
    ("public-domain", r'the author hereby places this (?:code|software|file|work) in the public domain'),
    ("RAIL-M", r'use restrictions\. you agree not to use the model or derivatives of the model'),
    ("Llama-community", r'distributed under the terms of this community license agreement'),
    ("proprietary", r'this software is the confidential and proprietary information of'),
    ("proprietary", r'no part of this (?:publication|document|software|work) may be reproduced, stored in a retrieval system, or transmitted'),
    ("proprietary", r'use of this software is subject to the terms of the end user license agreement'),
    ("proprietary", r'licensed, not sold'),
]

#: Usual titles and abbreviations that follow no pattern of NAMES, written one by one.
TITLES: list[tuple[str, str, str]] = [
    ("BSD-1-Clause", r"bsd[ -](?:1|one)[ -]clause(?: licen[sc]e)?", "bsd"),
    ("BSD-2-Clause", r"bsd[ -](?:2|two)[ -]clause(?: [\"“']?(?:simplified|freebsd)[\"”']?)?(?: licen[sc]e)?", "bsd"),
    ("BSD-3-Clause", r"bsd[ -](?:3|three)[ -]clause(?: [\"“']?(?:new|revised|modified)(?:[\"”']? or [\"“']?(?:new|revised|modified))?[\"”']?)?(?: licen[sc]e)?", "bsd"),
    ("BSD-4-Clause", r"bsd[ -](?:4|four)[ -]clause(?: [\"“']?(?:original|old)(?:[\"”']? or [\"“']?(?:original|old))?[\"”']?)?(?: licen[sc]e)?", "bsd"),
    ("GPL-1.0", r"(?:gnu )?gpl(?: version |[ -]?v\.? ?|[ -])1(?:\.0)?", "gpl"),
    ("GPL-2.0", r"(?:gnu )?gpl(?: version |[ -]?v\.? ?|[ -])2(?:\.0)?", "gpl"),
    ("GPL-3.0", r"(?:gnu )?gpl(?: version |[ -]?v\.? ?|[ -])3(?:\.0)?", "gpl"),
    ("GPL-2.0-or-later", r"(?:gnu )?gpl(?: version |[ -]?v\.? ?|[ -])2(?:\.0)?(?:\+|,? or (?:any )?(?:later|newer))", "gpl"),
    ("GPL-3.0-or-later", r"(?:gnu )?gpl(?: version |[ -]?v\.? ?|[ -])3(?:\.0)?(?:\+|,? or (?:any )?(?:later|newer))", "gpl"),
    ("GPL-2.0", r"gnu general public licen[sc]e \(gpl\),? (?:version |v\.? ?)2(?:\.0)?", "general public"),
    ("GPL-3.0", r"gnu general public licen[sc]e \(gpl\),? (?:version |v\.? ?)3(?:\.0)?", "general public"),
    ("LGPL-2.0", r"(?:gnu )?lgpl(?: version |[ -]?v\.? ?|[ -])2(?:\.0)?", "lgpl"),
    ("LGPL-2.1", r"(?:gnu )?lgpl(?: version |[ -]?v\.? ?|[ -])2\.1", "lgpl"),
    ("LGPL-3.0", r"(?:gnu )?lgpl(?: version |[ -]?v\.? ?|[ -])3(?:\.0)?", "lgpl"),
    ("LGPL-2.1-or-later", r"(?:gnu )?lgpl(?: version |[ -]?v\.? ?|[ -])2\.1(?:\+|,? or (?:any )?(?:later|newer))", "lgpl"),
    ("LGPL-3.0-or-later", r"(?:gnu )?lgpl(?: version |[ -]?v\.? ?|[ -])3(?:\.0)?(?:\+|,? or (?:any )?(?:later|newer))", "lgpl"),
    ("AGPL-3.0", r"(?:gnu )?agpl(?: version |[ -]?v\.? ?|[ -])3(?:\.0)?", "agpl"),
    ("AGPL-3.0-or-later", r"(?:gnu )?agpl(?: version |[ -]?v\.? ?|[ -])3(?:\.0)?(?:\+|,? or (?:any )?(?:later|newer))", "agpl"),
    ("Apache-2.0", r"apache[ -]v?2(?:\.0)?(?: licen[sc]e)?", "apache"),
    ("Apache-2.0", r"asl[ -]?(?:v\.? ?)?2(?:\.0)?", "asl"),
    ("MPL-1.1", r"mpl[ -]?(?:v\.? ?)?1\.1", "mpl"),
    ("MPL-2.0", r"mpl[ -]?(?:v\.? ?)?2(?:\.0)?", "mpl"),
    ("EPL-1.0", r"epl[ -]?(?:v\.? ?)?1(?:\.0)?", "epl"),
    ("EPL-2.0", r"epl[ -]?(?:v\.? ?)?2(?:\.0)?", "epl"),
    ("EUPL-1.2", r"eupl[ -]?(?:v\.? ?)?1\.2", "eupl"),
    ("CDDL-1.0", r"cddl[ -]?(?:v\.? ?)?1\.0", "cddl"),
    ("CDDL-1.1", r"cddl[ -]?(?:v\.? ?)?1\.1", "cddl"),
]

#: Families without a version, below all that names one.
FAMILIES: list[tuple[str, str, str]] = [
    ("GPL", r"gnu gpl", "gpl"),
    ("LGPL", r"gnu lgpl", "lgpl"),
    ("AGPL", r"gnu agpl", "agpl"),
    ("GPL", r"(?:released|licen[sc]ed|distributed|available) under (?:the )?(?:terms of )?(?:the )?gpl", "gpl"),
    ("LGPL", r"(?:released|licen[sc]ed|distributed|available) under (?:the )?(?:terms of )?(?:the )?lgpl", "lgpl"),
    ("AGPL", r"(?:released|licen[sc]ed|distributed|available) under (?:the )?(?:terms of )?(?:the )?agpl", "agpl"),
]

#: What may follow WITH in an SPDX expression.
EXCEPTIONS = ["Classpath-exception-2.0", "GCC-exception-2.0", "GCC-exception-3.1", "LLVM-exception", "Autoconf-exception-2.0", "Autoconf-exception-3.0", "Bison-exception-2.2", "Font-exception-2.0", "Linux-syscall-note", "Libtool-exception", "Bootloader-exception"]


def keyword(pattern: str) -> str:
    """The longest plain stretch of a pattern, whole words of it, that lies outside all groups."""
    plain = re.sub(r"\\\.", "\0", re.sub(r"\([^()]*\)[?]?|\[[^\]]*\][?]?|\.\{[^}]*\}\??|\\s\+", "\0", pattern.replace("(?:", "(")))
    plain = re.sub(r".\?|[\\<>|*+]", "\0", plain)
    return max((" ".join(x.split(" ")[1:-1]) for x in (" " + y.strip() + " " for y in plain.split("\0")) if x.strip()), key=len).strip()


def rules() -> list[tuple[str, str, int, tuple[str, ...], str]]:
    """All rules in order; a rule's place breaks ties of priority."""
    out = []
    for name, _, _ in NAMES:
        low = name.lower().replace(".", r"\.")
        out.append((name, "tag", TAG, ("spdx-license-identifier",), rf"spdx-license-identifier: ?{low}(?:-only)?(?![\w.-])"))
        out.append((name + "-or-later", "tag", TAG, ("spdx-license-identifier",), rf"spdx-license-identifier: ?{low}(?:-or-later|\+)(?![\w.-])"))
    for name, pattern, word in NAMES:
        grant = rf"(?:released|licen[sc]ed|distributed|published|available|provided|covered) (?:under|by|subject to) (?:the terms of )?(?:the )?(?:terms of )?(?:the )?(?:{pattern})"
        out.append((name, "notice", NOTICE, tuple(word.split("|")), grant))
    out += [(a, b, c, tuple(d.split("|")), e) for a, b, c, d, e in TEXTS]
    for name, pattern, word in NAMES:
        out.append((name, "name", NAME, tuple(word.split("|")), rf"(?<!\w)(?:{pattern})(?!\w)"))
    for name, pattern, word in TITLES:
        out.append((name, "name", NAME, (word,), rf"(?<![\w.-])(?:{pattern})(?![\w+]|[.-]\w)"))
    for name, pattern, word in FAMILIES:
        out.append((name, "name", NAME - 5, (word,), rf"(?<!\w)(?:{pattern})(?![\w+]|-\w)"))
    # bare identifiers; those that are words of their own, such as MIT or Ruby, say too little
    for name, _, _ in NAMES:
        if "-" in name or name == "0BSD":
            low = name.lower()
            esc = low.replace(".", r"\.")
            out.append((name, "name", NAME, (low,), rf"(?<![\w.-]){esc}(?:-only)?(?![\w+-]|\.\w)"))
            out.append((name + "-or-later", "name", NAME, (low,), rf"(?<![\w.-]){esc}(?:-or-later|\+)(?![\w+-]|\.\w)"))
    for name in EXCEPTIONS:
        low = name.lower()
        esc = low.replace(".", r"\.")
        out.append((name, "exception", TAG, (low,), rf"with {esc}(?![\w-]|\.\w)"))
    for name, pattern in PHRASES:
        mark = name == "proprietary"
        out.append((name, "mark" if mark else "text", MARK + 1 if mark else TEXT - 1, (keyword(pattern),), pattern))
    return out
