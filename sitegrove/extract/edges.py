"""What an extractor yields."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Edge:
    """A relation: to `href`, or to an inline asset with `inline_text` of `inline_type`."""

    type: str
    href: str | None = None
    target_type: str | None = None
    inline_text: str | None = None
    inline_type: str | None = None
    media: str | None = None
    condition: str | None = None
    in_head: bool | None = None
    node_path: str | None = None
    node_attrs: dict[str, str] = field(default_factory=dict)
    props: dict[str, str] = field(default_factory=dict)

    def row(self, ord_: int) -> tuple:
        return (self.type, ord_, self.href, self.target_type, self.inline_text, self.inline_type, self.media, self.condition, self.in_head, self.node_path, self.node_attrs, self.props)
