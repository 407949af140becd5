"""What project and solution files tell, a file at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: The columns of each table, and the one that names the file.
TABLES = {
    "projects": "project_id string, name string, path string, tfm string, output_type string, assembly_name string, kind string",
    "project_refs": "src_id string, dst_id string, ord int",
    "assembly_refs": "project_id string, path string",
    "solution_projects": "solution string, project_id string",
}
FILE_COLUMN = {"projects": "project_id", "project_refs": "src_id", "assembly_refs": "project_id", "solution_projects": "solution"}
#: How project files name things, and what tells the kinds of projects apart.
PROJECT_LINE = r'(?m)^Project\("[^"]*"\)\s*=\s*"[^"]*",\s*"([^"]+proj)"'
PROJECT_REF = r'(?is)<ProjectReference\s[^>]*?Include="([^"]+)"'
PACKAGE = r'(?is)<(?:PackageReference|FrameworkReference|Reference)\s[^>]*?Include="([^"]+)"'
SDK = r'(?is)<Project\s[^>]*?Sdk="([^"]+)"'
TEST_REFERENCES, TEST_NAMES = ["xunit", "nunit", "mstest", "microsoft.net.test.sdk"], [".tests", "tests"]
KINDS = [("Web API", ["microsoft.aspnetcore.app"]), ("Worker", ["microsoft.extensions.hosting"])]
#: Frameworks that an SDK brings along.
SDK_REFERENCES = {"microsoft.net.sdk.web": "Microsoft.AspNetCore.App", "microsoft.net.sdk.worker": "Microsoft.Extensions.Hosting"}

_SPACE = " \t\n\x0b\f\r"


def stem(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", re.split(r"[/\\]", path)[-1])


def tag(text: str, name: str) -> str | None:
    """The trimmed content of the first element of a name, None if there is none or it is empty."""
    found = re.search(rf"(?is)<{name}>(.*?)</{name}>", text)
    return found[1].strip(_SPACE) if found and found[1] else None


def from_folder(path: str, of: str) -> str:
    """A path that a file names, taken from the folder that the file stands in; .. and . are resolved."""
    done: list[str] = []
    for x in [*of.split("/")[:-1], *path.replace("\\", "/").split("/")]:
        if x == "..":
            done = done[:-1]
        elif x not in ("", "."):
            done.append(x)
    return "/".join(done)


def references(text: str) -> list[str]:
    """What a project file refers to outside of the solution, and what its SDK brings along."""
    sdk = re.search(SDK, text)
    brought = SDK_REFERENCES.get(sdk[1].lower()) if sdk else None
    return re.findall(PACKAGE, text) + ([brought] if brought else [])


def kind(refs: list[str], assembly: str) -> str:
    """Test by what is referred to or the assembly's name, else Web API, Worker or Library."""
    low = "\n".join(refs).lower()
    if any(m in assembly.lower() for m in TEST_NAMES) or any(m in low for m in TEST_REFERENCES):
        return "Test"
    return next((name for name, marks in KINDS if any(m in low for m in marks)), "Library")


def _projects(path: str, text: str) -> Iterator[tuple]:
    tfm = tag(text, "TargetFramework")
    assembly = tag(text, "AssemblyName")
    assembly = stem(path) if assembly is None else assembly
    yield path, stem(path), path, tag(text, "TargetFrameworks") if tfm is None else tfm, tag(text, "OutputType"), assembly, kind(references(text), assembly)


def _project_refs(path: str, text: str) -> Iterator[tuple]:
    first: dict[str, int] = {}
    for n, p in enumerate(re.findall(PROJECT_REF, text)):
        first.setdefault(from_folder(p, path), n)
    yield from ((path, to, n) for to, n in first.items())


def _assembly_refs(path: str, text: str) -> Iterator[tuple]:
    yield from ((path, x) for x in dict.fromkeys(references(text)))


def _solution_projects(path: str, text: str) -> Iterator[tuple]:
    yield from ((path, p) for p in dict.fromkeys(from_folder(x, path) for x in re.findall(PROJECT_LINE, text)))


READ = {"projects": _projects, "project_refs": _project_refs, "assembly_refs": _assembly_refs, "solution_projects": _solution_projects}
