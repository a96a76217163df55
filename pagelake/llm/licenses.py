"""License scans (operator 4) by sentence rules, in DataFrame functions only.

A text is cut into sentences; each is normalised and looked up among known
licence sentences. A sentence that says under what something is licensed becomes a
reference to that licence. The identifiers found, in text order, are matched
against rules, those with most sentences first; what a rule has matched is taken
out, so a rule gives way to a longer one around it. A rule's sentences follow one
another with no other known sentence between them, unless it has a ``*`` there.
SPDX lines are read on their own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences, written as in the licences.
SENTENCES = {
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit0-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "json-good": "The Software shall be used for Good, not Evil",
    "x11-name": "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium",
    "ncsa-notices": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers",
    "ncsa-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimers in the documentation and/or other materials provided with the distribution",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-2": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "postgresql-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "hpnd-grant": "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies, and that both that the copyright notice and this permission notice appear in supporting documentation",
    "bsl1-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
    "zlib-notice": "This notice may not be removed or altered from any source distribution",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "wtfpl-copy": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
    "apache2-use": "you may not use this file except in compliance with the License",
    "apache2-copy": "You may obtain a copy of the License at",
    "apache2-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache2-text": '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document',
    "apache2-patent": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work, where such license applies only to those patent claims licensable by such Contributor that are necessarily infringed by their Contribution(s) alone or by combination of their Contribution(s) with the Work to which such Contribution(s) was submitted",
    "mpl11-head": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License")',
    "mpl2-head": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "cddl1-head": "The contents of this file are subject to the terms of the Common Development and Distribution License (the License)",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-hope-2": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-merchant": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program",
    "gpl3-text": "The GNU General Public License is a free, copyleft license for software and other kinds of works",
    "agpl3-text": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software",
    "gpl2-text": "This License applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this General Public License",
    "lgpl3-text": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below",
    "ofl11-head": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "ofl11-goals": "The goals of the Open Font License (OFL) are to stimulate worldwide development of collaborative font projects, to support the font creation efforts of academic and linguistic communities, and to provide a free and open framework in which fonts may be shared and improved in partnership with others",
    "cc0-waiver": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "vim-text": "There are no restrictions on distributing unmodified copies of Vim except that they must include this license text",
    "gnu-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
    "artistic1-intent": "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package, while giving the users of the package the right to use and distribute the Package in a more-or-less customary fashion, plus the right to make reasonable modifications",
    "artistic2-terms": "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed",
    "upl-grant": 'Subject to the condition set forth below, permission is hereby granted to any person obtaining a copy of this software, associated documentation and/or data (collectively the "Software"), free of charge and under any and all copyright rights in the Software, and any and all patent rights owned or freely licensable by each licensor hereunder covering either (i) the unmodified Software as contributed to or provided by such licensor, or (ii) the Larger Works (as defined below), to deal in both',
    "ijg-text": "This software is based in part on the work of the Independent JPEG Group",
    "openssl-text": "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit",
    "php-text": "This product includes PHP software, freely available from <http://www.php.net/software/>",
    "php-name": 'The name "PHP" must not be used to endorse or promote products derived from this software without prior written permission',
    "epl1-title": "Eclipse Public License - v 1.0",
    "epl2-title": "Eclipse Public License - v 2.0",
    "epl-head": 'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT")',
    "epl2-secondary": '"Secondary License" means either the GNU General Public License, Version 2.0, or any later versions of that license, including any exceptions or additional permissions as identified by the initial Contributor',
    "cpl1-head": 'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS COMMON PUBLIC LICENSE ("AGREEMENT")',
    "ipl1-head": 'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS IBM PUBLIC LICENSE ("AGREEMENT")',
    "mpl2-contributor": '"Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software',
    "mpl2-covered": '"Covered Software" means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form, in each case including portions thereof',
    "mpl11-title": "Mozilla Public License Version 1.1",
    "npl11-title": "Netscape Public License Version 1.1",
    "initial-grant": "The Initial Developer hereby grants You a world-wide, royalty-free, non-exclusive license, subject to third party intellectual property claims",
    "cddl10-title": "Common Development and Distribution License (CDDL) Version 1.0",
    "cddl11-title": "Common Development and Distribution License (CDDL) Version 1.1",
    "cddl-grant": "Conditioned upon Your compliance with Section 3.1 below and subject to third party intellectual property claims, the Initial Developer hereby grants You a world-wide, royalty-free, non-exclusive license",
    "apache11-names": 'The names "Apache" and "Apache Software Foundation" must not be used to endorse or promote products derived from this software without prior written permission',
    "gpl1-text": "The license agreements of most software companies try to keep users at the mercy of those companies",
    "gnu2-freedom": "The licenses for most software are designed to take away your freedom to share and change it",
    "gnu3-freedom": "The licenses for most software and other practical works are designed to take away your freedom to share and change the works",
    "lgpl20-text": 'This License Agreement applies to any software library which contains a notice placed by the copyright holder or other authorized party saying it may be distributed under the terms of this Library General Public License (also called "this License")',
    "lgpl21-text": 'This License Agreement applies to any software library or other program which contains a notice placed by the copyright holder or other authorized party saying it may be distributed under the terms of this Lesser General Public License (also called "this License")',
    "gfdl12-title": "GNU Free Documentation License Version 1.2, November 2002",
    "gfdl13-title": "GNU Free Documentation License Version 1.3, 3 November 2008",
    "gfdl-purpose": 'The purpose of this License is to make a manual, textbook, or other functional and useful document "free" in the sense of freedom',
    "python2-between": 'This LICENSE AGREEMENT is between the Python Software Foundation ("PSF"), and the Individual or Organization ("Licensee") accessing and otherwise using this software ("Python") in source or binary form and its associated documentation',
    "cc0-text": 'The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an "owner") of an original work of authorship and/or a database (each, a "Work")',
    "osl3-text": 'This Open Software License (the "License") applies to any original work of authorship (the "Original Work") whose owner (the "Licensor") has placed the following licensing notice adjacent to the copyright notice for the Original Work',
    "afl3-text": 'This Academic Free License (the "License") applies to any original work of authorship (the "Original Work") whose owner (the "Licensor") has placed the following licensing notice adjacent to the copyright notice for the Original Work',
    "ecl2-text": 'The Educational Community License version 2.0 ("ECL") consists of the Apache 2.0 license, modified to change the scope of the patent grant in section 3 to be specific to the needs of the education communities using this license',
    "eupl11-text": 'This European Union Public Licence (the "EUPL") applies to the Work or Software (as defined below) which is provided under the terms of this Licence',
    "eupl12-text": 'This European Union Public Licence (the "EUPL") applies to the Work (as defined below) which is provided under the terms of this Licence',
    "ms-governs": "This license governs use of the accompanying software",
    "ms-accept": "If you use the software, you accept this license",
    "msrl-grants": "(A) Reciprocal Grants- For any file you distribute that contains code from the software (in source code or binary format), you must provide recipients the source code to that file along with a copy of this license, which license will govern that file",
    "qpl1-intent": "The intent of this license is to establish freedom to share and change the software regulated by this license under the open source model",
    "odbl1-text": "The Open Database License (ODbL) is a license agreement intended to allow users to freely share, modify, and use this Database while maintaining this same freedom for others",
    "mulan2-text": "Your reproduction, use, modification and distribution of the Software shall be subject to Mulan PSL v2 (this License) with the following terms and conditions",
    "blueoak-purpose": "This license gives everyone as much permission to work with this software as possible, while protecting contributors from liability",
    "blueoak-copyright": "Each contributor licenses you to do everything with this software that would otherwise infringe that contributor's copyright in it",
    "w3c-obtaining": "By obtaining, using and/or copying this work, you (the licensee) agree that you have read, understood, and will comply with the following terms and conditions",
}

#: The names of the Creative Commons licences in their texts.
CREATIVE = {
    "CC-BY-4.0": "Attribution", "CC-BY-SA-4.0": "Attribution-ShareAlike", "CC-BY-ND-4.0": "Attribution-NoDerivatives", "CC-BY-NC-4.0": "Attribution-NonCommercial",
    "CC-BY-NC-SA-4.0": "Attribution-NonCommercial-ShareAlike", "CC-BY-NC-ND-4.0": "Attribution-NonCommercial-NoDerivatives",
}

#: The GNU licences' names in notices, with the versions of each.
GNU = {
    "GPL": ("General Public License", ("1", "2", "3")),
    "LGPL": ("Lesser General Public License", ("2.1", "3")),
    "LGPL-2.0": ("Library General Public License", ("2",)),
    "AGPL": ("Affero General Public License", ("3",)),
}

#: SPDX identifiers and the names under which licences are referred to.
NAMES = {
    "0BSD": ("Zero-Clause BSD", "BSD Zero Clause License", "0BSD License"),
    "AFL-3.0": ("Academic Free License version 3.0", "Academic Free License 3.0", "AFL 3.0"),
    "AGPL-3.0": ("GNU Affero General Public License v3.0", "GNU Affero General Public License version 3", "GNU AGPL v3", "AGPLv3", "AGPL 3.0", "AGPL v3"),
    "Apache-1.1": ("Apache Software License, Version 1.1", "Apache License 1.1"),
    "Apache-2.0": ("Apache License, Version 2.0", 'Apache License, Version 2.0 (the "License")', "Apache License 2.0", "Apache 2.0", "Apache 2.0 License", "Apache License v2.0", "Apache 2 License", "Apache License Version 2", "Apache Software License 2.0"),
    "Artistic-1.0": ("Artistic License 1.0", "Artistic License"),
    "Artistic-2.0": ("Artistic License 2.0", "Artistic License version 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-clause BSD License", "Simplified BSD License", "FreeBSD License", "BSD-2"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD-3"),
    "BSD-4-Clause": ("BSD 4-Clause License", "4-clause BSD License", "Original BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License"),
    "BlueOak-1.0.0": ("Blue Oak Model License 1.0.0", "Blue Oak Model License"),
    "CC-BY-3.0": ("CC BY 3.0", "Creative Commons Attribution 3.0 Unported License", "Creative Commons Attribution 3.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-SA-3.0": ("CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "CC0", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 1.0 Universal"),
    "CDDL-1.0": ("Common Development and Distribution License 1.0", "CDDL 1.0", "CDDL", "Common Development and Distribution License"),
    "CDDL-1.1": ("Common Development and Distribution License 1.1", "CDDL 1.1"),
    "CECILL-2.1": ("CeCILL Free Software License Agreement v2.1", "CeCILL 2.1", "CeCILL v2.1"),
    "CPL-1.0": ("Common Public License 1.0", "Common Public License Version 1.0"),
    "ECL-2.0": ("Educational Community License, Version 2.0", "Educational Community License 2.0"),
    "EPL-1.0": ("Eclipse Public License v1.0", "Eclipse Public License 1.0", "Eclipse Public License - v 1.0", "EPL 1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License v. 2.0", "EPL 2.0"),
    "EUPL-1.1": ("European Union Public Licence 1.1", "EUPL 1.1", "EUPL, Version 1.1"),
    "EUPL-1.2": ("European Union Public Licence 1.2", "EUPL 1.2", "EUPL, Version 1.2"),
    "FTL": ("FreeType License", "FreeType Project License"),
    "GFDL-1.2": ("GNU Free Documentation License, Version 1.2", "GFDL 1.2"),
    "GFDL-1.3": ("GNU Free Documentation License, Version 1.3", "GFDL 1.3"),
    "GPL-1.0": ("GNU General Public License, version 1", "GPL 1.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GNU GPLv2", "GPLv2", "GPL v2", "GPL 2.0", "GPL version 2", "GNU General Public License version 2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GNU GPLv3", "GPLv3", "GPL v3", "GPL 3.0", "GPL version 3", "GNU General Public License version 3.0"),
    "ICU": ("ICU License",),
    "IJG": ("Independent JPEG Group License", "IJG License"),
    "IPL-1.0": ("IBM Public License Version 1.0", "IBM Public License v1.0"),
    "ISC": ("ISC License", "ISC"),
    "JSON": ("JSON License",),
    "LGPL-2.0": ("GNU Library General Public License version 2", "LGPL 2.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1", "LGPLv2.1", "LGPL 2.1", "LGPL v2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL v3", "LGPLv3", "LGPL 3.0", "LGPL v3"),
    "LPPL-1.3c": ("LaTeX Project Public License 1.3c", "LaTeX Project Public License v1.3c", "LPPL 1.3c"),
    "Libpng": ("libpng License",),
    "MIT": ("MIT License", "MIT", "Expat License"),
    "MIT-0": ("MIT No Attribution License", "MIT-0", "MIT-0 License", "MIT No Attribution"),
    "MPL-1.1": ("Mozilla Public License Version 1.1", "Mozilla Public License 1.1", "MPL 1.1"),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License Version 2.0", "MPL 2.0", "MPL v2.0", "MPL-2.0 License"),
    "MS-PL": ("Microsoft Public License", "Ms-PL"),
    "MS-RL": ("Microsoft Reciprocal License", "Ms-RL"),
    "MulanPSL-2.0": ("Mulan PSL v2", "Mulan Permissive Software License, Version 2"),
    "NCSA": ("University of Illinois/NCSA Open Source License", "NCSA Open Source License"),
    "NPL-1.1": ("Netscape Public License Version 1.1",),
    "ODbL-1.0": ("Open Database License", "Open Database License v1.0", "ODbL 1.0", "ODbL"),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "Open Font License 1.1"),
    "OSL-3.0": ("Open Software License version 3.0", "Open Software License 3.0", "OSL 3.0"),
    "OpenSSL": ("OpenSSL License",),
    "PHP-3.01": ("PHP License v3.01", "PHP License, version 3.01", "PHP License 3.01"),
    "PostgreSQL": ("PostgreSQL License",),
    "Python-2.0": ("Python License 2.0", "Python Software Foundation License", "PSF License", "Python Software Foundation License Version 2"),
    "QPL-1.0": ("Q Public License version 1.0", "Q Public License"),
    "Ruby": ("Ruby License", "Ruby's License"),
    "SISSL": ("Sun Industry Standards Source License",),
    "Sleepycat": ("Sleepycat License",),
    "UPL-1.0": ("Universal Permissive License v1.0", "Universal Permissive License v 1.0", "Universal Permissive License 1.0"),
    "Unicode-DFS-2016": ("Unicode License",),
    "Unlicense": ("Unlicense", "The Unlicense"),
    "Vim": ("Vim License",),
    "W3C": ("W3C Software Notice and License", "W3C Software License"),
    "WTFPL": ("WTFPL", "Do What The F*ck You Want To Public License"),
    "X11": ("X11 License",),
    "ZPL-2.1": ("Zope Public License, Version 2.1", "Zope Public License 2.1", "ZPL 2.1"),
    "Zlib": ("zlib License", "zlib/libpng License"),
}

#: Rule, licence, and its sentences in order ("|": either; "*": other known sentences may lie here).
RULES = (
    ("mit-text", "MIT", "mit-grant mit-notice mit-warranty"),
    ("mit0-text", "MIT-0", "mit0-grant mit-warranty"),
    ("json-text", "JSON", "mit-grant mit-notice json-good mit-warranty"),
    ("x11-text", "X11", "mit-grant mit-notice mit-warranty * x11-name"),
    ("ncsa-text", "NCSA", "mit-grant ncsa-notices ncsa-binary"),
    ("isc-text", "ISC", "isc-grant|isc-grant-2 isc-warranty"),
    ("0bsd-text", "0BSD", "0bsd-grant isc-warranty"),
    ("postgresql-text", "PostgreSQL", "postgresql-grant"),
    ("hpnd-text", "HPND", "hpnd-grant"),
    ("bsl1-text", "BSL-1.0", "bsl1-grant"),
    ("bsd4-text", "BSD-4-Clause", "bsd-grant bsd-source bsd-binary bsd-advert bsd-name"),
    ("bsd3-text", "BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-name"),
    ("bsd2-text", "BSD-2-Clause", "bsd-grant bsd-source bsd-binary"),
    ("zlib-text", "Zlib", "zlib-warranty zlib-grant zlib-altered zlib-notice"),
    ("unlicense-text", "Unlicense", "unlicense-free"),
    ("wtfpl-text", "WTFPL", "wtfpl-copy"),
    ("apache2-header", "Apache-2.0", "ref-Apache-2.0 apache2-use apache2-copy apache2-basis"),
    ("apache2-text", "Apache-2.0", "apache2-text * apache2-patent"),
    ("mpl11-header", "MPL-1.1", "mpl11-head apache2-use|mpl11-head"),
    ("mpl2-header", "MPL-2.0", "mpl2-head"),
    ("cddl1-header", "CDDL-1.0", "cddl1-head"),
    ("gpl3-text", "GPL-3.0-only", "gpl3-text"),
    ("agpl3-text", "AGPL-3.0-only", "agpl3-text"),
    ("gpl2-text", "GPL-2.0-only", "gpl2-text"),
    ("lgpl3-text", "LGPL-3.0-only", "lgpl3-text"),
    ("ofl11-text", "OFL-1.1", "ofl11-head|ofl11-goals"),
    ("cc0-waiver", "CC0-1.0", "cc0-waiver"),
    ("vim-text", "Vim", "vim-text"),
    ("upl1-text", "UPL-1.0", "upl-grant"),
    ("ijg-text", "IJG", "ijg-text"),
    ("openssl-text", "OpenSSL", "openssl-text"),
    ("php-text", "PHP-3.01", "php-name|php-text"),
    ("artistic1-text", "Artistic-1.0", "artistic1-intent"),
    ("artistic2-text", "Artistic-2.0", "artistic2-terms"),
    ("epl1-text", "EPL-1.0", "epl1-title epl-head"),
    ("epl2-text", "EPL-2.0", "epl2-title epl-head"),
    ("epl2-body", "EPL-2.0", "epl-head epl2-secondary"),
    ("cpl1-text", "CPL-1.0", "cpl1-head"),
    ("ipl1-text", "IPL-1.0", "ipl1-head"),
    ("mpl2-text", "MPL-2.0", "mpl2-contributor mpl2-covered"),
    ("mpl11-text", "MPL-1.1", "mpl11-title initial-grant"),
    ("npl11-text", "NPL-1.1", "npl11-title initial-grant"),
    ("cddl10-text", "CDDL-1.0", "cddl10-title cddl-grant"),
    ("cddl11-text", "CDDL-1.1", "cddl11-title cddl-grant"),
    ("apache11-text", "Apache-1.1", "bsd-source bsd-binary apache11-names"),
    ("gpl1-text", "GPL-1.0-only", "gpl1-text"),
    ("lgpl20-text", "LGPL-2.0-only", "lgpl20-text"),
    ("lgpl21-text", "LGPL-2.1-only", "lgpl21-text"),
    ("gfdl12-text", "GFDL-1.2", "gfdl12-title gnu-verbatim gfdl-purpose"),
    ("gfdl13-text", "GFDL-1.3", "gfdl13-title gnu-verbatim gfdl-purpose"),
    ("python2-text", "Python-2.0", "python2-between"),
    ("cc0-text", "CC0-1.0", "cc0-text"),
    ("osl3-text", "OSL-3.0", "osl3-text ref-OSL-3.0"),
    ("afl3-text", "AFL-3.0", "afl3-text ref-AFL-3.0"),
    ("ecl2-text", "ECL-2.0", "ecl2-text"),
    ("eupl11-text", "EUPL-1.1", "eupl11-text"),
    ("eupl12-text", "EUPL-1.2", "eupl12-text"),
    ("msrl-text", "MS-RL", "ms-governs ms-accept msrl-grants"),
    ("mspl-text", "MS-PL", "ms-governs ms-accept"),
    ("qpl1-text", "QPL-1.0", "qpl1-intent"),
    ("odbl1-text", "ODbL-1.0", "odbl1-text"),
    ("mulan2-text", "MulanPSL-2.0", "mulan2-text"),
    ("blueoak-text", "BlueOak-1.0.0", "blueoak-purpose blueoak-copyright"),
    ("w3c-text", "W3C", "w3c-obtaining"),
)

#: A sentence ends at one of these marks before a blank, at a blank line, or at the end.
END = r"[.!?:;]+([\x20\x09-\x0D]+|\z)|\n[\x20\x09-\x0D]*\n"
#: A full stop after these is no end mark ("v. 2.0").
SHORT = r"\b(?:(v|ver|vers)\.[\x20\x09-\x0D]|(inc|corp|ltd|co|no)\.[\x20\x09])"

#: A normalised sentence that names a licence: who or what, the verb, the name, what follows.
REFERENCE = (
    r"^(?:(?:this|the|these|all|our|it|its|code|content|files?|everything|project|software)(?: [a-z0-9]+){0,10}? (?:is|are) )?(?:also |dual |double )?(?:free software )?"
    r"(?:licensed|licenced|released|distributed|available|made available|provided|published|covered|governed) (?:to you )?(?:under|by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:a )?"
    r"(.+?)(?: (?:see|which|as found|found in|in the license|a copy|whose|for more|for details|unless|refer|or any later|or at your option|or later).*)?$"
)
#: Names of holders differ: what stands between is left out.
HOLDER = r"^neither the name of .+ nor the names of "
_HOLDER = "neither the name of the copyright holder nor the names of "

#: The SPDX line and what separates identifiers in it.
SPDX, SPDX_CUT = r"spdx-license-identifier:[\x20\x09]*([^\n\r]*)", r"[^a-z0-9.+-]+"

#: Every text with a known sentence or a reference holds one of these, so others need no cutting.
TRIGGERS = r"licen|software|copyright|redistribut|warranty|permission|hereby|(?:this[^a-z0-9]+(?:file|notice)|without[^a-z0-9]+even|either[^a-z0-9]+version)[^a-z0-9]|(?:released|distributed|available|provided|published|covered|governed)[^a-z0-9]+(?:to[^a-z0-9]+you[^a-z0-9]+)?(?:under|by)[^a-z0-9]"


def normalize(text: str) -> str:
    """Lower-case letters and digits with one space between groups."""
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def gnu_sentences() -> dict[str, str]:
    """The GNU notices, whether their clauses are parted by commas or by semicolons."""
    out = {}
    for name, (title, versions) in GNU.items():
        terms = f"you can redistribute it and/or modify it under the terms of the GNU {title} as published by the Free Software Foundation"
        out[f"{name}-terms"] = terms
        for v in versions:
            later = f"either version {v} of the License, or (at your option) any later version"
            out[f"later-{v}"] = later
            out[f"{name}-later-{v}"] = f"{terms}, {later}"
            out[f"{name}-only-{v}"] = terms.replace(f"GNU {title}", f"GNU {title} version {v}")
            out[f"{name}-version-{v}"] = f"{terms}, version {v}"
    return out


def gnu_rules() -> list[tuple[str, str, str]]:
    out = []
    for name, (_, versions) in GNU.items():
        for v in versions:
            licence = f"{name.removesuffix('-2.0')}-{v if '.' in v else v + '.0'}"
            out.append((f"{name.lower()}-{v}-or-later", f"{licence}-or-later", f"{name}-terms later-{v}"))
            out.append((f"{name.lower()}-{v}-or-later-notice", f"{licence}-or-later", f"{name}-later-{v}"))
            out.append((f"{name.lower()}-{v}-only", f"{licence}-only", f"{name}-only-{v}|{name}-version-{v}"))
    return out


def creative_sentences() -> dict[str, str]:
    """The sentence by which each Creative Commons text is accepted."""
    terms = "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons"
    return {f"{name.lower()}-accept": f'{terms} {title} 4.0 International Public License ("Public License")' for name, title in CREATIVE.items()}


def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier."""
    short = re.compile(SHORT)
    return {normalize(short.sub(lambda m: f"{m[1] or m[2]} ", x.lower())): name for name, x in (SENTENCES | gnu_sentences() | creative_sentences()).items()}


def known_names() -> dict[str, str]:
    """Normalised name of a licence to its SPDX identifier; a closing "license" may be missing or added."""
    out = {}
    for name, texts in NAMES.items():
        for x in texts:
            plain = normalize(x)
            bare = plain.removesuffix(" license")
            for y in (plain, bare, f"{bare} license"):
                if y == plain or len(bare.split()) > 1 or y != bare:
                    out.setdefault(y, name)
    return out


def spdx_ids() -> dict[str, str]:
    """Lower-case SPDX identifiers, with the GNU ones' endings, to the written ones."""
    out = {x.lower(): x for x in [*NAMES, "HPND"]}
    for name in [x for x in NAMES if re.match("A?L?GPL-", x)]:
        out |= {f"{name}{end}".lower(): f"{name}{end}" for end in ("-only", "-or-later")} | {f"{name}+".lower(): f"{name}-or-later"}
    return out


def ordered_rules() -> list[tuple[str, str, str]]:
    """Rule, licence and pattern; those with most sentences first."""
    rules = [*RULES, *gnu_rules(), *[(f"{x.lower()}-text", x, f"{x.lower()}-accept") for x in CREATIVE]]
    return [(n, lic, rule_pattern(x)) for n, lic, x in sorted(rules, key=lambda r: -len(r[2].replace(" *", "").split()))]


def rule_pattern(rule: str) -> str:
    """Pattern for a line in which each identifier stands between blanks of its own."""
    one = lambda x: "(?: [^ ]+ )*" if x == "*" else "(?:" + "|".join(f" {re.escape(y)} " for y in x.split("|")) + ")"
    return "".join(map(one, rule.split()))


_silent = [name for x, name in known_sentences().items() if not re.search(TRIGGERS, x)]
if _silent:
    raise ValueError(f"no trigger occurs in {_silent}")


def _map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences and references (``ref-`` and SPDX id) of a text, in order.

    A sentence starts after an end mark or a blank line. A notice may also stand on
    a line of its own after text without an end mark, so of
    a sentence that spans lines the lines are looked up, too. Of equal identifiers
    in a row one counts.
    """
    low = F.lower(text)
    parts = F.split(F.regexp_replace(low, SHORT, "$1$2 "), END)
    lines = F.flatten(F.transform(parts, lambda p: F.when(F.contains(p, F.lit("\n")), F.concat(F.array(p), F.split(p, "\n"))).otherwise(F.array(p))))
    clean = F.transform(lines, lambda p: F.regexp_replace(F.trim(F.regexp_replace(p, "[^a-z0-9]+", " ")), HOLDER, _HOLDER))
    named = lambda p: F.try_element_at(_map(known_names()), F.regexp_extract(p, REFERENCE, 1))
    each = lambda p: F.coalesce(F.try_element_at(_map(known_sentences()), p), F.concat(F.lit("ref-"), named(p)))
    found = F.filter(F.transform(F.filter(clean, lambda p: F.length(p) > 9), each), lambda x: x.isNotNull())
    once = F.aggregate(found, F.array().cast("array<string>"), lambda a, x: F.when(F.try_element_at(a, F.lit(-1)).eqNullSafe(x), a).otherwise(F.concat(a, F.array(x))))
    return F.when(low.rlike(TRIGGERS), once).otherwise(F.array().cast("array<string>"))


def spdx_lines(text: Column) -> Column:
    """Known identifiers of the text's ``SPDX-License-Identifier`` lines, in order."""
    low = F.lower(text)
    words = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(SPDX), F.lit(1)), lambda x: F.split(x, SPDX_CUT)))
    found = F.filter(F.transform(words, lambda w: F.try_element_at(_map(spdx_ids()), w)), lambda x: x.isNotNull())
    return F.when(F.contains(low, F.lit("spdx-license-identifier:")), found).otherwise(F.array().cast("array<string>"))


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, sentence_ids, rules, licenses`` of every row; arrays are empty where nothing is found.

    ``rules``: those that matched, with most sentences first, then ``reference-`` and
    ``spdx-`` with the licence in text order, each once. ``licenses`` are sorted and
    distinct. Null and empty texts have none. Whole texts are scanned, however
    long; repeated rows give repeated results, rows that share an id one each.
    One pass, no shuffle; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), sentence_ids(text).alias("sentence_ids"), spdx_lines(text).alias("spdx"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(lic).alias("license"), F.lit(p).alias("pattern")) for n, lic, p in ordered_rules()])
    line = F.array_join(F.transform("sentence_ids", lambda x: F.concat(F.lit(" "), x, F.lit(" "))), "")
    none = F.array().cast("array<struct<rule:string,license:string>>")

    def match(state: Column, r: Column) -> Column:
        hit = F.regexp(state["line"], r["pattern"])
        return F.when(hit, F.struct(F.regexp_replace(state["line"], r["pattern"], F.lit(" | ")).alias("line"), F.concat(state["hits"], F.array(F.struct(r["rule"].alias("rule"), r["license"].alias("license")))).alias("hits"))).otherwise(state)

    start = F.struct(line.alias("line"), none.alias("hits"))
    rows = rows.withColumn("state", F.when(F.size("sentence_ids") > 0, F.aggregate(rules, start, match)).otherwise(start))
    named = lambda prefix: lambda x: F.struct(F.concat(F.lit(prefix), x).alias("rule"), x.alias("license"))
    left = F.transform(F.filter(F.split("state.line", " +"), lambda x: x.startswith("ref-")), lambda x: F.substring(x, 5, 1000))
    hits = F.concat("state.hits", F.transform(F.array_distinct(left), named("reference-")), F.transform(F.array_distinct("spdx"), named("spdx-")))
    rows = rows.select("doc_id", "sentence_ids", hits.alias("hits"))
    return rows.select("doc_id", "sentence_ids", F.col("hits.rule").alias("rules"), F.array_sort(F.array_distinct(F.col("hits.license"))).alias("licenses"))
