"""Wordings of public licenses: fixed values, whole where they are short, else the notice that the license asks to be put into files."""

from __future__ import annotations

# Names by which texts call a license, after "Licensed under the", "Released under", and alone.
NAMES = {
    "0BSD": ["BSD Zero Clause License", "0BSD License"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3.0", "AGPL v3.0", "AGPL, version 3.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 License", "Apache 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "2-Clause BSD License"],
    "BSD-3-Clause": ["BSD License", "BSD 3-Clause License", "3-Clause BSD License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2.0", "GPL v2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3.0", "GPL v3.0"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPL v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3.0", "LGPL v3.0"],
    "MIT": ["MIT License", "MIT"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL v2.0"],
    "Zlib": ["zlib License"],
}
SENTENCES = ["Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "Licensed under {}.", "Released under {}.", "This program is licensed under {}.", "This program is licensed under the {}.", "{}."]
LATER = ["Licensed under the {} or later.", "Licensed under the {} or any later version.", "This program is licensed under {} or later.", "This program is licensed under the {} or any later version."]
TAG = "SPDX-License-Identifier: {}."

# Creative Commons licenses are named by their elements.
ELEMENTS = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
CREATIVE_COMMONS = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"]
CC_VERSIONS = {"3.0": "Unported", "4.0": "International"}

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_CLAUSES = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."


def _gnu(thing: str, name: str, version: str, mark: str, end: str) -> str:
    return (
        f"This {thing} is free software{mark} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.\n"
        f"This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.\n"
        f"You should have received a copy of the {name} along with this {thing}{end}"
    )


_WRITE = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
_SEE = ". If not, see <https://www.gnu.org/licenses/>."

TEXTS = {
    "0BSD": f"{_ISC_GRANT}.\n{_ISC_AS_IS}",
    "AGPL-3.0": _gnu("program", "GNU Affero General Public License", "3", ":", _SEE),
    "All-Rights-Reserved": "All rights reserved.\nNo part of this work may be reproduced or distributed without prior written permission of the copyright holder.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": f"{_BSD_CLAUSES}\n{_BSD_AS_IS}",
    "BSD-3-Clause": f"{_BSD_CLAUSES}\n{_BSD_THIRD}\n{_BSD_AS_IS}",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "CC0-1.0": "Licensed under CC0 1.0. This work is dedicated to the public domain under CC0 1.0 Universal. To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": _gnu("program", "GNU General Public License", "2", ";", _WRITE),
    "GPL-3.0": _gnu("program", "GNU General Public License", "3", ":", _SEE),
    "ISC": f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_AS_IS}",
    "LGPL-2.1": _gnu("library", "GNU Lesser General Public License", "2.1", ";", _WRITE),
    "LGPL-3.0": _gnu("library", "GNU Lesser General Public License", "3", ":", _SEE),
    "MIT": f"{_GRANT}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_AS_IS}",
    "MIT-0": f"{_GRANT}.\n{_AS_IS}",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Public-Domain": "Released into the public domain. This work is in the public domain.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
}


def templates() -> dict[str, str]:
    """The wording of each license, with the sentences that name it."""
    found = {}
    for name, text in TEXTS.items():
        forms = SENTENCES + (LATER if "GPL" in name else [])
        found[name] = "\n".join([*(s.format(n) for n in NAMES.get(name, []) for s in forms), TAG.format(name), *([TAG.format(f"{name}-or-later")] if "GPL" in name else []), text])
    for code in CREATIVE_COMMONS:
        full = "-".join(ELEMENTS[e] for e in code.split("-"))
        for version, form in CC_VERSIONS.items():
            found[f"CC-{code}-{version}"] = f"{TAG.format(f'CC-{code}-{version}')}\nLicensed under CC {code} {version}.\nThis work is licensed under a Creative Commons {full} {version} {form} License.\nThis work is licensed under the Creative Commons {full} {version} License."
    return found
