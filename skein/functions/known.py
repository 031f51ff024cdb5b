"""Fixed values of name resolution: names and packages that are never part of a repository."""

from __future__ import annotations

#: Runtime and test-framework globals of TypeScript.
TS_GLOBALS = (
    "Array Boolean Buffer Date Error JSON Map Math Number Object Promise Proxy RangeError Reflect RegExp Set String Symbol "
    "TypeError URL WeakMap WeakSet afterAll afterEach beforeAll beforeEach clearInterval clearTimeout console crypto "
    "decodeURIComponent describe encodeURIComponent expect exports fetch isFinite isNaN it jest module parseFloat parseInt "
    "process require setInterval setTimeout structuredClone test"
).split()
TS_PACKAGES = "express jsonwebtoken mongoose mongoose-unique-validator passport react react-dom slugify".split()
#: Go's predeclared identifiers.
GO_BUILTINS = (
    "any append bool byte cap clear close comparable complex complex128 complex64 copy delete error false float32 float64 "
    "imag int int16 int32 int64 int8 iota len make max min new nil panic print println real recover rune string true uint "
    "uint16 uint32 uint64 uint8 uintptr"
).split()
GO_PACKAGES = ["github.com/modelcontextprotocol/go-sdk/mcp", "github.com/pkoukk/tiktoken-go"]
#: C# names and namespace roots.
CS_BUILTINS = "default nameof typeof".split()
CS_ROOTS = "Ardalis AutoMapper Autofac Blazored FluentAssertions MediatR Microsoft Moq NSubstitute Newtonsoft Serilog System Xunit".split()
#: Python built-ins that can be called, and well-known top-level packages.
PY_BUILTINS = (
    "AttributeError Exception FileNotFoundError IOError ImportError IndexError KeyError NotImplementedError OSError RuntimeError "
    "StopIteration TypeError ValueError ZeroDivisionError __import__ abs all any bool bytearray bytes callable classmethod compile "
    "delattr dict dir divmod enumerate eval exec filter float format frozenset getattr globals hasattr hash id input int isinstance "
    "issubclass iter len list locals map max min next open pow print property range repr reversed round set setattr sorted "
    "staticmethod str sum super tuple type vars zip"
).split()
PY_PACKAGES = (
    "abc boto3 celery collections copy datetime django functools itertools json jwt logging math os pytest random re requests "
    "rest_framework sqlalchemy string sys time typing unittest uuid"
).split()
BUILTINS = {"ts": TS_GLOBALS, "go": GO_BUILTINS, "cs": CS_BUILTINS, "py": PY_BUILTINS}
