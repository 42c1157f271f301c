"""Templates of public licenses, with SPDX-style markup: (label, wording).

Short licenses stand here in full, from the grant to the end of the disclaimer; of long ones the
notice that the license itself asks to put into files.  Copyright lines are no part of the wording.
"""

from __future__ import annotations

_MIT_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;words=1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""

_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND <<var;words=1-12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;words=1-12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT
OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_ISC_GRANT = """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is
hereby granted"""

_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""

_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<var;words=1-12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;words=1-12>> BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _gnu(what: str, name: str, version: str) -> str:
    """The notice that licenses of the GNU family ask for."""
    return f"""This {what} is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the {name} as
    published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {what} is distributed
    in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
    PURPOSE. See the {name} for more details."""


# Wording of public licenses.
TEXTS = [
    (
        "mit",
        f"""{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next
        paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. {_MIT_DISCLAIMER}""",
    ),
    ("mit-0", f"{_MIT_GRANT}. {_MIT_DISCLAIMER}"),
    ("isc", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_DISCLAIMER}"),
    ("0bsd", f"{_ISC_GRANT}. {_ISC_DISCLAIMER}"),
    ("bsd-2-clause", f"{_BSD_GRANT} {_BSD_DISCLAIMER}"),
    (
        "bsd-3-clause",
        f"""{_BSD_GRANT} <<beginOptional>>3.<<endOptional>> Neither the name of <<var;words=1-12>> nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission. {_BSD_DISCLAIMER}""",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
        from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
        it and redistribute it freely, subject to the following restrictions: <<beginOptional>>1.<<endOptional>> The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. <<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such,
        and must not be misrepresented as being the original software. <<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any
        source distribution.""",
    ),
    (
        "bsl-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered
        by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the
        Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software
        and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the
        Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
        machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
        IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT
        SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "unlicense",
        f"""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
        this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions
        that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We
        make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt
        act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_MIT_DISCLAIMER}
        <<beginOptional>>For more information, please refer to <<var;words=1-6>><<endOptional>>""",
    ),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy
        of the License at <<var;words=1-8>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    ),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
        obtain one at <<var;words=1-8>>""",
    ),
    (
        "epl-2.0",
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which
        <<beginOptional>>accompanies this distribution, and<<endOptional>> is available at <<var;words=1-8>>""",
    ),
    (
        "cc0-1.0",
        """To the extent possible under law, <<var;words=1-12>> dedicated all copyright and related and neighboring rights to this software to the public domain
        worldwide. This software is distributed without any warranty.""",
    ),
    ("gpl-2.0-or-later", _gnu("program", "GNU General Public License", "2")),
    ("gpl-3.0-or-later", _gnu("program", "GNU General Public License", "3")),
    ("lgpl-2.1-or-later", _gnu("library", "GNU Lesser General Public License", "2.1")),
    ("lgpl-3.0-or-later", _gnu("program", "GNU Lesser General Public License", "3")),
    ("agpl-3.0-or-later", _gnu("program", "GNU Affero General Public License", "3")),
    ("cc-by-4.0", "This work is licensed under <<beginOptional>>a<<endOptional>><<beginOptional>>the<<endOptional>> Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under <<beginOptional>>a<<endOptional>><<beginOptional>>the<<endOptional>> Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "This work is licensed under <<beginOptional>>a<<endOptional>><<beginOptional>>the<<endOptional>> Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd-4.0", "This work is licensed under <<beginOptional>>a<<endOptional>><<beginOptional>>the<<endOptional>> Creative Commons Attribution-NoDerivatives 4.0 International License"),
]

#: One-line notices, which name a license instead of quoting it.
NOTICES = [
    ("mit-notice", "released under the MIT license"),
    ("mit-notice", "licensed under the MIT license"),
    ("apache-2.0-notice", "licensed under the Apache License<<beginOptional>>, Version<<endOptional>> 2.0"),
    ("gpl-notice", "licensed under the GNU General Public License<<beginOptional>>, version <<var;words=1-2>><<endOptional>>"),
    ("lgpl-notice", "licensed under the GNU Lesser General Public License<<beginOptional>>, version <<var;words=1-2>><<endOptional>>"),
    ("mpl-2.0-notice", "licensed under the Mozilla Public License<<beginOptional>>, v<<endOptional>><<beginOptional>>, version<<endOptional>> 2.0"),
    ("cc-by-nc-notice", "licensed under CC BY-NC<<beginOptional>> <<var;words=2-2>><<endOptional>>"),
    ("cc-by-sa-notice", "licensed under CC BY-SA<<beginOptional>> <<var;words=2-2>><<endOptional>>"),
    ("cc-by-nd-notice", "licensed under CC BY-ND<<beginOptional>> <<var;words=2-2>><<endOptional>>"),
    ("spdx-notice", "SPDX-License-Identifier: <<var;words=1-4>>"),
    ("copyright-notice", "copyright c <<var;words=1-12>> all rights reserved"),
]
