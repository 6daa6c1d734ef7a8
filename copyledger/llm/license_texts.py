"""Notices of public licenses: whole texts, and the short forms that stand in
file headers.  A notice is (label, words that must stand literally, text); the
words tell versions and variants apart whose notices are otherwise alike.
"""

# FIXED VALUES (texts as their publishers give them)

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction"""
_MIT_REST = """including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met"""
_BSD_TWO = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY
OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License."""
_APACHE_REST = """You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as
published by the Free Software Foundation, either version {version} of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."""
_MPL_REST = """If a copy of the MPL was not distributed with this file, You can obtain one at
https://mozilla.org/MPL/2.0/."""
_CC = "licensed under a Creative Commons {name} 4.0 International License"
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""

_GNU_LICENSES = [
    ("gpl-2", "General Public License", "2"),
    ("gpl-3", "General Public License", "3"),
    ("lgpl-2.1", "Lesser General Public License", "2.1"),
    ("lgpl-3", "Lesser General Public License", "3"),
    ("agpl-3", "Affero General Public License", "3"),
]
_CC_LICENSES = [
    ("cc-by", "Attribution"),
    ("cc-by-sa", "Attribution-ShareAlike"),
    ("cc-by-nd", "Attribution-NoDerivatives"),
    ("cc-by-nc", "Attribution-NonCommercial"),
    ("cc-by-nc-sa", "Attribution-NonCommercial-ShareAlike"),
    ("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivatives"),
]

NOTICES = [
    ("mit", "", _MIT_GRANT),
    ("mit", "", f"{_MIT_GRANT}, {_MIT_REST}"),
    ("isc", "", _ISC),
    ("bsd", "", _BSD_GRANT),
    ("bsd-2", "", f"{_BSD_GRANT}: {_BSD_TWO} {_BSD_DISCLAIMER}"),
    ("bsd-3", "", f"{_BSD_GRANT}: {_BSD_TWO} {_BSD_THIRD} {_BSD_DISCLAIMER}"),
    ("apache-2", "Apache License Version 2", _APACHE),
    ("apache-2", "Apache License Version 2", f"{_APACHE} {_APACHE_REST}"),
    ("mpl-2", "Mozilla Public License v 2 0", _MPL),
    ("mpl-2", "Mozilla Public License v 2 0", f"{_MPL} {_MPL_REST}"),
    ("unlicense", "", _UNLICENSE),
    ("gpl", "the GNU General Public License", """you can redistribute it and/or modify it under the terms of the GNU
     General Public License as published by the Free Software Foundation"""),
    ("gpl-3", "the GNU General Public License version 3", "licensed under the GNU General Public License version 3"),
    *[(label, f"GNU {name} as published by the Free Software Foundation either version {version} of the License",
       _GNU.format(name=name, version=version)) for label, name, version in _GNU_LICENSES],
    *[(label, f"Commons {name} 4 0", _CC.format(name=name)) for label, name in _CC_LICENSES],
]
