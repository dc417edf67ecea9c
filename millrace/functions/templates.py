"""``${name}`` templates, read once when a flow is compiled."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Macro:
    """One ``${...}``; its name is itself a template, so macros can nest."""

    name: "Template"


@dataclass(frozen=True)
class Template:
    parts: tuple[str | Macro, ...]

    @property
    def text(self) -> str | None:
        """The whole text if there is no macro in it."""
        if any(isinstance(p, Macro) for p in self.parts):
            return None
        return "".join(self.parts)

    @property
    def names(self) -> set[str] | None:
        """Names the macros read; None if some name is known only per record."""
        found: set[str] = set()
        for part in self.parts:
            if isinstance(part, Macro):
                name = part.name.text
                if name is None:
                    return None
                found.add(name)
        return found

    @property
    def single_name(self) -> str | None:
        """The name, if the template is one plain macro and nothing else."""
        if len(self.parts) == 1 and isinstance(self.parts[0], Macro):
            return self.parts[0].name.text
        return None


def parse_template(text: str) -> Template:
    """Text outside complete macros, ``${}`` among it, is literal."""
    # A stack of open macros; an unclosed one turns back into literal text.
    levels: list[list[str | Macro]] = [[]]
    at = 0
    while at < len(text):
        if text.startswith("${", at):
            levels.append([])
            at += 2
        elif text[at] == "}" and len(levels) > 1:
            inner = levels.pop()
            if inner:
                levels[-1].append(Macro(Template(_join(inner))))
            else:
                levels[-1].append("${}")
            at += 1
        else:
            levels[-1].append(text[at])
            at += 1
    while len(levels) > 1:
        inner = levels.pop()
        levels[-1] += ["${", *inner]
    return Template(_join(levels[0]))


def _join(parts: list[str | Macro]) -> tuple[str | Macro, ...]:
    joined: list[str | Macro] = []
    for part in parts:
        if isinstance(part, str) and joined and isinstance(joined[-1], str):
            joined[-1] += part
        else:
            joined.append(part)
    return tuple(joined)
