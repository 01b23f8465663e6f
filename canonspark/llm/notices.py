"""Licence notices: label, text and the phrase that must stand in full.

Fixed values: the wording of the notices that files carry, as the licences
recommend it; punctuation doesn't matter, words are lower-cased alphanumerics."""

from __future__ import annotations

NOTICES = (
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version.", "GNU Affero General Public License as published by"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
     "required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS "
     "IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
     "you may not use this file except in compliance with the License"),
    ("artistic-2", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic "
     "License version 2.0", "Artistic License version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use in source and binary forms"),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
     "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
     "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
     "with the distribution.", "Redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
     "promote products derived from this software without specific prior written permission.",
     "may be used to endorse or promote products derived from this software"),
    ("boost-1", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
     "http://www.boost.org/LICENSE_1_0.txt)", "Boost Software License Version 1 0"),
    ("cc-by-4", "This work is licensed under the Creative Commons Attribution 4.0 International License.",
     "Creative Commons Attribution 4 0 International License"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc-4", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
     "Creative Commons Attribution NonCommercial 4 0"),
    ("cc-by-nc-nd-4", "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 "
     "International License.", "Attribution NonCommercial NoDerivatives 4 0"),
    ("cc-by-nc-sa-4", "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International "
     "License.", "Attribution NonCommercial ShareAlike 4 0"),
    ("cc-by-nd-4", "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License.",
     "Creative Commons Attribution NoDerivatives 4 0"),
    ("cc-by-sa-3", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
     "available under the Creative Commons Attribution ShareAlike License"),
    ("cc-by-sa-4", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
     "Creative Commons Attribution ShareAlike 4 0"),
    ("cc0-1", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this "
     "work.", "has waived all copyright and related or neighboring rights"),
    ("cddl-1", "The contents of this file are subject to the terms of the Common Development and Distribution License (the "
     "\"License\"). You may not use this file except in compliance with the License.",
     "Common Development and Distribution License"),
    ("ecl-2", "Licensed under the Educational Community License, Version 2.0 (the \"License\"); you may not use this file except "
     "in compliance with the License.", "Educational Community License Version 2 0"),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
     "2.0 which is available at https://www.eclipse.org/legal/epl-2.0", "Eclipse Public License 2 0"),
    ("eupl-1.2", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - "
     "subsequent versions of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence.",
     "approved by the European Commission"),
    ("gfdl-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free "
     "Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant "
     "Sections, no Front-Cover Texts, and no Back-Cover Texts.", "GNU Free Documentation License Version 1 3"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
     "later version.", "either version 2 of the License or at your option any later version"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-3-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
     "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
     "License for more details.", "under the terms of the GNU General Public License as published by"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies.",
     "for any purpose with or without fee is hereby granted"),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
     "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
     "option) any later version.", "either version 2 1 of the License"),
    ("lgpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version.", "GNU Lesser General Public License as published by"),
    ("mit", "released under the mit license", "mit license"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
     "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
     "this permission notice shall be included in all copies or substantial portions of the Software.",
     "Permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("ms-pl", "This source code is subject to the terms of the Microsoft Public License (Ms-PL).", "Microsoft Public License"),
    ("no-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
     "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
     "without warranty of any kind express or implied"),
    ("odbl-1", "This database is made available under the Open Database License: "
     "http://opendatacommons.org/licenses/odbl/1.0/. Any rights in individual contents of the database are licensed under the "
     "Database Contents License.", "made available under the Open Database License"),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "SIL Open Font License Version 1 1"),
    ("psf-2", "PSF is making Python available to Licensee on an \"AS IS\" basis. PSF MAKES NO REPRESENTATIONS OR WARRANTIES, "
     "EXPRESS OR IMPLIED.", "PSF makes no representations or warranties"),
    ("public-domain", "This work has been released into the public domain by its author. This applies worldwide.",
     "released into the public domain"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
     "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
     "purpose, commercial or non-commercial, and by any means.", "free and unencumbered software"),
    ("wtfpl-2", "This program is free software. It comes without any warranty, to the extent permitted by applicable law. You "
     "can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2.",
     "Do What The Fuck You Want To Public License"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
     "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for "
     "any purpose, including commercial applications, and to alter it and redistribute it freely.",
     "in no event will the authors be held liable for any damages"),
)

PHRASE_TEXTS = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
