"""A tagging endpoint: requests that a policy permits, through a transport that is plugged in, and replies as rows.

The client is a plain function over a picture's bytes, for ``passes.tag_pass``; it runs on the executors.
"""

from __future__ import annotations

import base64
import ipaddress
import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from fotolith.functions.media import ALLOWED_HOSTS
from fotolith.operators.passes import Unreachable

#: (status, body) of a method, URL, body and number of seconds; raises OSError if the host can't be reached.
Transport = Callable[[str, str, bytes | None, float], tuple[int, bytes]]
MOST_TOKENS = 1600
_SHARED = ipaddress.ip_network("100.64.0.0/10")


class Blocked(RuntimeError):
    """The policy doesn't permit the host."""


def host_of(url: str) -> str | None:
    m = re.match(r"[^:/?#]+://([^/?#]*)", url)
    host = m[1].rsplit("@", 1)[-1] if m else ""
    return (host[1:].split("]")[0] if host.startswith("[") else host.split(":")[0]) or None


@dataclass(frozen=True)
class Policy:
    """Private addresses, the hosts that are allowed by name, and ``extra`` ones; the same rule as ``media.permits``."""

    extra: tuple[str, ...] = ()
    unrestricted: bool = False

    def permits(self, url: str) -> bool:
        host = host_of(url)
        if self.unrestricted:
            return True
        if host is None:
            return False
        try:
            ip = ipaddress.ip_address(host)
        except ValueError:
            name = host.lower()
            return name == "localhost" or name.endswith(".localhost") or name in {h.lower() for h in (*ALLOWED_HOSTS, *self.extra)}
        if ip.version == 4:
            return ip.is_loopback or ip.is_link_local or ip in _SHARED or any(ip in ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"))
        return ip.is_loopback or ip in ipaddress.ip_network("fc00::/7") or ip in ipaddress.ip_network("fe80::/10")


def plain(method: str, url: str, body: bytes | None, seconds: float) -> tuple[int, bytes]:
    request = urllib.request.Request(url, body, {"Content-Type": "application/json"} if body is not None else {}, method=method)
    try:
        with urllib.request.urlopen(request, timeout=seconds) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


@dataclass(frozen=True)
class Egress:
    """Every request goes through the policy first."""

    policy: Policy = field(default_factory=Policy)
    transport: Transport = plain

    def _send(self, method: str, url: str, body: bytes | None, seconds: float) -> tuple[int, bytes]:
        if not self.policy.permits(url):
            raise Blocked(url)
        try:
            return self.transport(method, url, body, seconds)
        except OSError as e:
            raise Unreachable(str(e)) from None

    def fetch(self, url: str, seconds: float = 30) -> str:
        return self.download(url, seconds).decode()

    def download(self, url: str, seconds: float = 300) -> bytes:
        status, body = self._send("GET", url, None, seconds)
        if status >= 400:
            raise ValueError(f"status {status}")
        return body

    def post(self, url: str, body: dict, seconds: float = 300) -> tuple[int, bytes]:
        return self._send("POST", url, json.dumps(body).encode(), seconds)


@dataclass(frozen=True)
class Endpoint:
    """A server that answers chats about pictures, below ``base``."""

    base: str
    model: str
    egress: Egress = field(default_factory=Egress)
    vocabulary: tuple[str, ...] = ()

    def healthy(self) -> bool:
        """Whether the server says so, or nothing at all."""
        body = self.egress.fetch(f"{self.base.rstrip('/')}/health")
        return "ok" in body or not body.strip()

    def models(self) -> list[str]:
        found = json.loads(self.egress.fetch(f"{self.base.rstrip('/')}/v1/models"))
        return [m["id"] for m in found.get("data") or [] if isinstance(m.get("id"), str)]

    def request(self, picture: bytes) -> dict:
        """What is sent for a picture: a question, the picture, and the form that the answer must have."""
        name = {"type": "string", "enum": list(self.vocabulary)} if self.vocabulary else {"type": "string"}
        tag = {"type": "object", "properties": {"name": name, "confidence": {"type": "number"}}, "required": ["name", "confidence"]}
        form = {"type": "object", "properties": {"tags": {"type": "array", "items": tag}, "description": {"type": "string"}}, "required": ["tags"]}
        ask = "Name what the photograph shows, each with a confidence from 0 to 1, and describe it in a sentence."
        picture_url = f"data:image/jpeg;base64,{base64.b64encode(picture).decode()}"
        content = [{"type": "text", "text": ask}, {"type": "image_url", "image_url": {"url": picture_url}}]
        return {"model": self.model, "temperature": 0, "max_tokens": MOST_TOKENS, "response_format": {"type": "json_schema", "json_schema": {"schema": form}}, "messages": [{"role": "user", "content": content}]}

    def tag(self, picture: bytes) -> dict:
        """Tags, description and tokens of a picture. Thinking is asked to be off; a server that refuses to be asked is asked
        again without."""
        url, body = f"{self.base.rstrip('/')}/v1/chat/completions", self.request(picture)
        status, reply = self.egress.post(url, body | {"chat_template_kwargs": {"enable_thinking": False}})
        if status >= 400:
            status, reply = self.egress.post(url, body)
        if status >= 400:
            raise ValueError(f"status {status}")
        return parsed(reply)


def parsed(reply: bytes) -> dict:
    """A reply's tags, surest first and one a name, with description and token counts; raises ValueError."""
    found = json.loads(reply)
    choice = (found.get("choices") or [None])[0]
    if choice is None:
        raise ValueError("no choices in the reply")
    content = (choice.get("message") or choice).get("content") or ""
    if not content.strip():
        raise ValueError("an empty reply")
    inside = re.sub(r"^```(?:json)?|```$", "", content.strip()).strip()
    try:
        said = json.loads(inside)
        tags = [(str(t["name"]).strip(), float(t["confidence"])) for t in said["tags"]]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError(f"{e}: {content[:200]}{'…' if len(content) > 200 else ''}") from None
    best: dict[str, tuple[str, float]] = {}
    for name, sure in tags:
        if name and (name.lower() not in best or best[name.lower()][1] < sure):
            best[name.lower()] = name, sure
    usage, text = found.get("usage") or {}, said.get("description")
    return {
        "tags": sorted(best.values(), key=lambda t: (-t[1], t[0])),
        "description": text if text and text.strip() else None,
        "prompt_tokens": int(usage.get("prompt_tokens") or 0),
        "completion_tokens": int(usage.get("completion_tokens") or 0),
    }
