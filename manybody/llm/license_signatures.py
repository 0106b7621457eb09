"""License signatures written one by one: label, priority, keywords (one of them is in every match), expression.

Expressions are on lower-cased words with one space between them; sentences are those of the
licenses' own texts, notices and identifiers. Priority 1: identifiers and texts, 2: notices that
grant by name, 3: clauses that name a license, 4: clauses that several licenses share, 6: mentions.
"""

_ID = "spdx license identifier"

SIGNATURES = (
    # identifiers
    ("gpl-1", 1, _ID, "spdx license identifier gpl 1 0 only"),
    ("gpl-1+", 1, _ID, "spdx license identifier gpl 1 0 or later"),
    ("gpl-2", 1, _ID, "spdx license identifier gpl 2 0 only"),
    ("gpl-2+", 1, _ID, "spdx license identifier gpl 2 0 or later"),
    ("gpl-2-classpath", 1, _ID, "spdx license identifier gpl 2 0(?: only| or later)? with classpath exception 2 0"),
    ("gpl-2-linux-syscall", 1, _ID, "spdx license identifier gpl 2 0(?: only| or later)? with linux syscall note"),
    ("gpl-3", 1, _ID, "spdx license identifier gpl 3 0 only"),
    ("gpl-3+", 1, _ID, "spdx license identifier gpl 3 0 or later"),
    ("gpl-3-gcc", 1, _ID, "spdx license identifier gpl 3 0(?: only| or later)? with gcc exception 3 1"),
    ("lgpl-2", 1, _ID, "spdx license identifier lgpl 2 0 only"),
    ("lgpl-2+", 1, _ID, "spdx license identifier lgpl 2 0 or later"),
    ("lgpl-2.1", 1, _ID, "spdx license identifier lgpl 2 1 only"),
    ("lgpl-2.1+", 1, _ID, "spdx license identifier lgpl 2 1 or later"),
    ("lgpl-3", 1, _ID, "spdx license identifier lgpl 3 0 only"),
    ("lgpl-3+", 1, _ID, "spdx license identifier lgpl 3 0 or later"),
    ("agpl-3", 1, _ID, "spdx license identifier agpl 3 0 only"),
    ("agpl-3+", 1, _ID, "spdx license identifier agpl 3 0 or later"),
    ("apache-2-llvm", 1, _ID, "spdx license identifier apache 2 0 with llvm exception"),
    ("apache-2-or-mit", 1, _ID, "spdx license identifier (?:apache 2 0 or mit|mit or apache 2 0)"),
    ("mit-0", 1, _ID, "spdx license identifier mit 0"),
    ("mit-cmu", 1, _ID, "spdx license identifier mit cmu"),
    ("bsd-2-clause-patent", 1, _ID, "spdx license identifier bsd 2 clause patent"),
    ("bsd-3-clause-clear", 1, _ID, "spdx license identifier bsd 3 clause clear"),
    ("bsd-3-clause-lbnl", 1, _ID, "spdx license identifier bsd 3 clause lbnl"),
    ("bsd-source-code", 1, _ID, "spdx license identifier bsd source code"),
    ("blueoak-1", 1, _ID, "spdx license identifier blueoak 1 0 0"),
    ("cc-by-sa-2.5", 1, _ID, "spdx license identifier cc by sa 2 5"),
    ("cc-by-nc-3", 1, _ID, "spdx license identifier cc by nc 3 0"),
    ("cecill-2.1", 1, _ID, "spdx license identifier cecill 2 1"),
    ("ecl-2", 1, _ID, "spdx license identifier ecl 2 0"),
    ("efl-2", 1, _ID, "spdx license identifier efl 2 0"),
    ("gfdl-1.3", 1, _ID, "spdx license identifier gfdl 1 3(?: only| or later)?"),
    ("hpnd", 1, _ID, "spdx license identifier hpnd"),
    ("icu", 1, _ID, "spdx license identifier icu"),
    ("ijg", 1, _ID, "spdx license identifier ijg"),
    ("mulanpsl-2", 1, _ID, "spdx license identifier mulanpsl 2 0"),
    ("osl-3", 1, _ID, "spdx license identifier osl 3 0"),
    ("afl-3", 1, _ID, "spdx license identifier afl 3 0"),
    ("rpl-1.5", 1, _ID, "spdx license identifier rpl 1 5"),
    ("sspl-1", 1, _ID, "spdx license identifier sspl 1 0"),
    ("bsl-1.1", 1, _ID, "spdx license identifier busl 1 1"),
    ("unicode-3", 1, _ID, "spdx license identifier unicode (?:3 0|dfs 201[56])"),
    ("vim", 1, _ID, "spdx license identifier vim"),
    ("w3c", 1, _ID, "spdx license identifier w3c"),
    ("x11", 1, _ID, "spdx license identifier x11"),
    ("zpl-2.1", 1, _ID, "spdx license identifier zpl 2 1"),
    ("unlicensed", 1, _ID, "spdx license identifier (?:none|noassertion)"),
    # MIT and its kin
    ("mit", 1, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 3, "without restriction including", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
    ("mit", 3, "shall be included in all copies", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 4, "the software is provided as is", "the software is provided as is without warranty of any kind express or implied"),
    ("mit-0", 2, "mit no attribution", "(?:the )?mit no attribution(?: license)?"),
    ("mit-modern", 2, "mit license modern variant", "mit license modern variant"),
    ("x11", 3, "x consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("hpnd", 2, "permission to use copy modify", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted"),
    ("isc", 1, "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 3, "disclaims all warranties", "the author disclaims all warranties with regard to this software"),
    ("curl", 2, "permission to use copy modify", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("ntp", 3, "appears in all copies", "provided that the above copyright notice appears in all copies and that both the copyright notice and this permission notice appear"),
    ("unicode", 2, "unicode", "unicode inc license agreement data files and software"),
    ("icu", 2, "icu license", "icu license icu 1 8 1 and later"),
    # BSD
    ("bsd", 2, "redistribution and use in source", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 4, "redistributions of source code", "redistributions of source code must retain the above copyright notice this list of conditions"),
    ("bsd", 4, "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd-3-clause", 1, "endorse or promote", "neither the names? of (?:[^ ]+ ){1,16}may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause", 2, "endorse or promote", "may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 1, "all advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-1-clause", 2, "bsd 1 clause", "bsd 1 clause license"),
    ("bsd-3-clause-clear", 2, "clear bsd", "(?:the )?clear bsd license"),
    ("bsd-2-clause-patent", 2, "bsd 2 clause", "bsd 2 clause plus patent license"),
    ("bsd-protection", 2, "bsd protection", "bsd protection license"),
    ("bsd", 3, "bsd style", "bsd style license"),
    ("bsd", 3, "in the license file", "governed by a bsd style license that can be found in the license file|use of this source code is governed by a license found in the license file"),
    ("bsd", 2, "regents of the university", "the regents of the university of california all rights reserved"),
    # Apache
    ("apache-2", 1, "apache license version 2 0 the license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", 1, "apache org licenses", "(?:http|https) www apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2", 3, "distributed on an as is basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", 3, "licensed to the apache software", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", 3, "see the license for the specific", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-1.1", 2, "apache software foundation", "this product includes software developed by the apache software foundation"),
    ("apache-1", 2, "apache group", "this product includes software developed by the apache group for use in the apache http server project"),
    ("apache-2-llvm", 2, "llvm exceptions", "(?:part of the llvm project )?under the apache license v2 0 with llvm exceptions"),
    ("apache-2-or-mit", 2, "apache", "(?:dual )?licensed under (?:the )?(?:apache(?: license)?(?: version)? 2 0 (?:and|or) (?:the )?mit|mit (?:and|or) (?:the )?apache(?: license)?(?: version)? 2 0)"),
    # GNU
    ("gpl-2+", 1, "general public license", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3+", 1, "general public license", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-1+", 1, "general public license", "gnu general public license as published by the free software foundation either version 1 or at your option any later version"),
    ("gpl-2", 1, "general public license", "gnu general public license version 2 (?:only )?as published by the free software foundation"),
    ("gpl-3", 1, "general public license", "gnu general public license version 3 (?:only )?as published by the free software foundation"),
    ("gpl-2", 2, "general public license", "gnu general public license version 2 june 1991"),
    ("gpl-3", 2, "general public license", "gnu general public license version 3 29 june 2007"),
    ("gpl", 4, "general public license", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", 4, "general public license", "see the gnu general public license for more details"),
    ("gpl", 5, "general public license", "gnu general public license"),
    ("gpl-2+", 2, "gplv2", "gplv2 (?:or later|or any later version|plus)"),
    ("gpl-3+", 2, "gplv3", "gplv3 (?:or later|or any later version|plus)"),
    ("gpl-2-classpath", 2, "classpath exception", "gpl(?:v2| v2| 2)? with (?:the )?classpath exception"),
    ("gpl-2-linux-syscall", 3, "user programs that use kernel", "this copyright does not cover user programs that use kernel services by normal system calls"),
    ("gpl-3-gcc", 2, "gcc runtime library exception", "gcc runtime library exception version 3 1"),
    ("gpl-font", 3, "embed this font", "if you create a document which uses this font and embed this font"),
    ("lgpl-2+", 1, "general public license", "gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl-2.1+", 1, "general public license", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3+", 1, "general public license", "gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.1", 2, "general public license", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl", 4, "general public license", "see the gnu (?:lesser|library) general public license for more details"),
    ("lgpl", 5, "general public license", "gnu (?:lesser|library) general public license"),
    ("lgpl", 6, "lgpl", "(?:gnu )?lgpl"),
    ("agpl-3+", 1, "affero general public license", "gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3", 2, "affero general public license", "gnu affero general public license version 3 19 november 2007"),
    ("agpl", 5, "affero general public license", "(?:gnu )?affero general public license"),
    ("agpl", 6, "agpl", "(?:gnu )?agpl"),
    ("agpl-1", 2, "affero", "affero general public license version 1 march 2002"),
    ("gfdl", 2, "free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl-1.2", 2, "free documentation license", "gnu free documentation license version 1 2"),
    ("gfdl-1.3", 2, "free documentation license", "gnu free documentation license version 1 3"),
    ("gfdl", 5, "free documentation license", "gnu free documentation license"),
    ("fsf-unlimited", 2, "free software foundation gives unlimited", "the free software foundation gives unlimited permission to copy and or distribute it"),
    ("all-permissive", 2, "copying and distribution of this file", "copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    # Mozilla, Eclipse and others with one owner
    ("mpl-2", 1, "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", 2, "mozilla org mpl", "(?:http|https) mozilla org mpl 2 0"),
    ("mpl-2-no-copyleft", 2, "incompatible with secondary", "this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0"),
    ("mpl-1.1", 1, "mozilla public license", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1", 1, "mozilla public license", "the contents of this file are subject to the mozilla public license version 1 0"),
    ("mpl-1.1-gpl-lgpl", 1, "tri license|mpl 1 1 gpl", "mpl 1 1 gpl 2 0 lgpl 2 1"),
    ("npl-1.1", 2, "netscape public license", "netscape public license(?: version)? 1 1"),
    ("epl-1", 1, "eclipse public license", "made available under the terms of the eclipse public license v1 0"),
    ("epl-2", 1, "eclipse public license", "made available under the terms of the eclipse public license (?:v )?2 0"),
    ("epl-2", 2, "eclipse org legal", "(?:http|https) www eclipse org legal epl (?:2 0|v20(?: html)?)"),
    ("edl-1", 2, "eclipse distribution license", "eclipse distribution license (?:v )?(?:1 0|version 1 0)"),
    ("cpl-1", 1, "common public license", "made available under the terms of the common public license v1 0"),
    ("ipl-1", 2, "ibm public license", "ibm public license version 1 0"),
    ("cddl-1.1", 1, "common development and distribution", "common development and distribution license(?: cddl)? version 1 1"),
    ("cddl-1", 1, "common development and distribution", "subject to the terms of the common development and distribution license(?: version 1 0 only)?"),
    ("cpal-1", 2, "common public attribution", "common public attribution license version 1 0"),
    ("sissl", 2, "sun industry standards", "sun industry standards source license"),
    ("spl-1", 2, "sun public license", "sun public license version 1 0"),
    ("apsl-2", 2, "apple public source", "apple public source license version 2 0"),
    ("aml", 3, "consideration of your agreement", "in consideration of your agreement to (?:abide by )?the following terms"),
    ("ms-pl", 2, "microsoft public license", "microsoft public license ms pl"),
    ("ms-rl", 2, "microsoft reciprocal license", "microsoft reciprocal license ms rl"),
    ("ms-lpl", 2, "microsoft limited public", "microsoft limited public license"),
    ("nokos", 2, "nokia open source", "nokia open source license"),
    ("qpl-1", 2, "q public license", "(?:the )?q public license version 1 0"),
    ("rpsl-1", 2, "realnetworks public", "realnetworks public source license(?: version 1 0)?"),
    ("sgi-b-2", 2, "sgi free software", "sgi free software license b version 2 0"),
    ("watcom-1", 2, "sybase open watcom", "sybase open watcom public license"),
    ("intel", 2, "intel open source", "intel open source license"),
    ("osl-3", 2, "open software license", "open software license (?:version |v )?3 0"),
    ("osl-2.1", 2, "open software license", "open software license (?:version |v )?2 1"),
    ("afl-2.1", 2, "academic free license", "academic free license (?:version |v )?2 1"),
    ("afl-3", 2, "academic free license", "academic free license (?:version |v )?3 0"),
    ("ecl-2", 2, "educational community", "educational community license(?: version)? 2 0"),
    ("eupl-1.1", 2, "eupl", "eupl (?:version |v )?1 1"),
    ("eupl-1.2", 1, "eupl", "licensed under the eupl (?:version 1 2 )?(?:or as soon they will be approved by the european commission)?(?: subsequent versions of the eupl)?"),
    ("cecill-2", 2, "cecill", "governed by the cecill license under french law"),
    ("cecill-b", 2, "cecill", "governed by the cecill b license under french law"),
    ("cecill-c", 2, "cecill", "governed by the cecill c license under french law"),
    ("lppl-1.3c", 1, "latex project public", "latex project public license either version 1 3c? of this license or at your option any later version"),
    ("lppl", 3, "latex project public", "latex project public license"),
    ("artistic", 4, "artistic license", "(?:the )?artistic license"),
    ("perl", 1, "same terms as perl", "(?:redistribute it and or modify it )?under the same terms as perl(?: itself)?"),
    ("php-3", 1, "of the php license", "this source file is subject to version 3 (?:0|01) of the php license"),
    ("php-3", 2, "php net license", "(?:http|https) www php net license 3 01 txt"),
    ("zend-2", 2, "zend", "subject to version 2 00 of the zend license|zend engine license"),
    ("psf-2", 2, "psf license agreement", "psf license agreement for python [0-9]"),
    ("cnri-python", 2, "cnri", "cnri (?:open source )?license agreement"),
    ("zpl-2.1", 2, "zope public license", "zope public license(?: zpl)? version 2 1"),
    ("tcl", 2, "tcl", "tcl tk license"),
    ("ruby", 2, "ruby", "(?:same terms as ruby|ruby s license)"),
    ("vim", 2, "vim license", "(?:the )?vim license"),
    ("sleepycat", 2, "sleepycat", "sleepycat (?:public )?license"),
    ("openldap", 2, "openldap", "openldap public license(?: version 2 8)?"),
    ("openssl", 1, "openssl project", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", 2, "cryptographic software", "this product includes cryptographic software written by eric young"),
    ("postgresql", 2, "postgresql", "postgresql is released under the postgresql license"),
    ("sqlite", 2, "disclaims copyright", "the author disclaims copyright to this source code"),
    ("libpng", 2, "png reference library", "png reference library license version 2"),
    ("zlib", 1, "provided as is without any express", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", 3, "altered source versions", "altered source versions must be plainly marked as such"),
    ("ijg", 2, "independent jpeg group", "this software is based in part on the work of the independent jpeg group"),
    ("freetype", 2, "freetype", "(?:portions of this software are copyright (?:c )?[0-9]{4} the freetype project|the freetype project license)"),
    ("bzip2", 2, "bzip2", "bzip2 and libbzip2 license"),
    ("info-zip", 2, "info zip", "info zip license"),
    ("w3c", 2, "w3c software", "w3c software (?:and document )?notice and license"),
    ("boost-1", 1, "boost software license", "distributed under the boost software license version 1 0"),
    ("boost-1", 2, "boost org license", "(?:http|https) www boost org license 1 0 txt"),
    ("blueoak-1", 2, "blue oak", "blue oak model license(?: version)?(?: 1 0 0)?"),
    ("mulanpsl-2", 2, "mulan", "mulan (?:psl v2|permissive software license version 2)"),
    ("upl-1", 2, "universal permissive", "licensed under the universal permissive license v 1 0"),
    # dedications and jokes
    ("unlicense", 1, "free and unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc0-1", 1, "waived all copyright", "waived all copyright and related or neighboring rights to"),
    ("cc0-1", 2, "cc0", "cc0 1 0 universal(?: public domain dedication)?"),
    ("public-domain", 3, "public domain", "this (?:file|work|code|software|document) is (?:hereby )?in the public domain"),
    ("public-domain", 3, "public domain", "not (?:protected by|subject to) copyright (?:[^ ]+ ){0,12}in the public domain"),
    ("pdm", 2, "public domain mark", "public domain mark 1 0"),
    ("beerware", 2, "beerware|beer ware", "beer ?ware license"),
    ("wtfpl", 1, "do what the fuck", "you just do what the fuck you want to"),
    ("json", 1, "good not evil", "the software shall be used for good not evil"),
    # Creative Commons and data
    ("cc-by-4", 1, "creativecommons org licenses", "creativecommons org licenses by 4 0"),
    ("cc-by-3", 1, "creativecommons org licenses", "creativecommons org licenses by 3 0"),
    ("cc-by-2", 1, "creativecommons org licenses", "creativecommons org licenses by 2 0"),
    ("cc-by-sa-4", 1, "creativecommons org licenses", "creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3", 1, "creativecommons org licenses", "creativecommons org licenses by sa 3 0"),
    ("cc-by-nd-4", 1, "creativecommons org licenses", "creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-4", 1, "creativecommons org licenses", "creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-sa-4", 1, "creativecommons org licenses", "creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4", 1, "creativecommons org licenses", "creativecommons org licenses by nc nd 4 0"),
    ("cc0-1", 1, "creativecommons org publicdomain", "creativecommons org publicdomain zero 1 0"),
    ("pdm", 1, "creativecommons org publicdomain", "creativecommons org publicdomain mark 1 0"),
    ("cc-by", 3, "creative commons attribution", "creative commons attribution(?: [0-9] [0-9])?(?: international| unported| generic)? licen[cs]e"),
    ("cc-by-sa", 3, "creative commons attribution", "creative commons attribution share ?alike(?: [0-9] [0-9])?(?: international| unported| generic)? licen[cs]e"),
    ("cc-by-nd", 3, "creative commons attribution", "creative commons attribution no ?deriv(?:s|atives)(?: [0-9] [0-9])?(?: international| unported| generic)? licen[cs]e"),
    ("cc-by-nc", 3, "creative commons attribution", "creative commons attribution non ?commercial(?: [0-9] [0-9])?(?: international| unported| generic)? licen[cs]e"),
    ("cc-by-nc-sa", 3, "creative commons attribution", "creative commons attribution non ?commercial share ?alike(?: [0-9] [0-9])?(?: international| unported| generic)? licen[cs]e"),
    ("cc-by-nc-nd", 3, "creative commons attribution", "creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [0-9] [0-9])?(?: international| unported| generic)? licen[cs]e"),
    ("cc", 6, "creative commons", "creative commons licen[cs]e"),
    ("odbl-1", 2, "open database license", "made available under the open database license"),
    ("cdla-permissive-2", 2, "community data license", "community data license agreement permissive(?: version)? 2 0"),
    ("cdla-sharing-1", 2, "community data license", "community data license agreement sharing(?: version)? 1 0"),
    ("ogl-uk-3", 2, "open government licen", "open government licen[cs]e v(?:ersion )?3(?: 0)?"),
    ("ogl-canada-2", 2, "open government licen", "open government licen[cs]e canada"),
    ("dl-de-by-2", 2, "datenlizenz", "datenlizenz deutschland namensnennung(?: version)? 2 0"),
    ("etalab-2", 2, "licence ouverte", "licence ouverte(?: open licence)?(?: version)? 2 0"),
    ("ofl-1.1", 1, "open font license", "this font software is licensed under the sil open font license version 1 1"),
    # source-available and model licenses
    ("sspl-1", 2, "server side public", "server side public license"),
    ("bsl-1.1", 2, "business source license", "business source license 1 1"),
    ("elastic-2", 2, "elastic license", "elastic license(?: version)? 2 0"),
    ("commons-clause", 2, "commons clause", "commons clause(?: license condition)?(?: v1 0)?"),
    ("polyform-nc-1", 2, "polyform", "polyform noncommercial license(?: 1 0 0)?"),
    ("polyform-sb-1", 2, "polyform", "polyform small business license(?: 1 0 0)?"),
    ("confluent", 2, "confluent community", "confluent community license(?: agreement)?(?: version)?(?: 1 0)?"),
    ("fsl-1.1", 2, "functional source license", "functional source license(?: version)? 1 1"),
    ("hippocratic-2.1", 2, "hippocratic", "hippocratic license(?: version)?(?: 2 1)?"),
    ("parity-7", 2, "parity public license", "parity public license(?: 7 0 0)?"),
    ("llama-2", 1, "llama 2 community", "llama 2 is licensed under the llama 2 community license"),
    ("llama-3", 1, "meta llama 3", "meta llama 3 is licensed under the meta llama 3 community license"),
    ("openrail", 2, "responsible ai license|rail license", "(?:open )?(?:responsible ai license|rail license)"),
    # reservations
    ("proprietary", 3, "proprietary", "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", 3, "strictly prohibited", "unauthorized (?:copying|reproduction|use)(?: or distribution)? (?:of this (?:file|document|work|software) )?(?:[^ ]+ ){0,8}is strictly prohibited"),
    ("proprietary", 3, "may not be reproduced", "may not be reproduced (?:[^ ]+ ){0,12}without (?:the )?(?:express |prior )*written (?:permission|consent)"),
    ("non-commercial", 4, "commercial use", "(?:for )?(?:non ?commercial use only|personal and non ?commercial use)"),
    ("non-commercial", 4, "commercial use", "commercial use (?:is )?(?:strictly )?prohibited"),
)
