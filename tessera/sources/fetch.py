"""One artefact from a url: redirects by hand, each hop checked before and after it is connected."""

from __future__ import annotations

from urllib.parse import urljoin

from . import validate as V
from .parse import URL_ORDER, Triple, guess_format, parse_text

# What is asked for, and the codes that are followed.
ACCEPT = "text/turtle, application/rdf+xml, application/ld+json, application/n-triples, application/n-quads, */*;q=0.1"
REDIRECTS = (301, 302, 303, 307, 308)
TIMEOUT = 10


def peer_address(response) -> str | None:
    """The address that a streamed response came from, if the library tells."""
    try:
        return response.raw._connection.sock.getpeername()[0]
    except AttributeError:
        return None


def follow(url: str, get, check=V.check_url, peer=peer_address):
    """The response behind at most ``MAX_REDIRECTS`` redirects. ``get``: requests.get or the like."""
    for _ in range(V.MAX_REDIRECTS + 1):
        check(url)
        response = get(url, headers={"Accept": ACCEPT}, timeout=TIMEOUT, allow_redirects=False, stream=True)
        address = peer(response)
        if address:
            V.check_address(address)
        if response.status_code not in REDIRECTS:
            return response
        target = response.headers.get("Location")
        if not target:
            raise V.ArtefactNotFoundError("Redirect without a target", url=url)
        url = urljoin(url, target)
    raise V.ArtefactValidationError("Too many redirects", url=url)


def fetch(url: str, get=None, **checks) -> list[Triple]:
    """Triples of a url; the content type's format is tried first."""
    if get is None:
        import requests

        get = requests.get
    response = follow(url, get, **checks)
    if response.status_code != 200:
        raise V.ArtefactNotFoundError("Cannot load artefact", url=url, http_status=response.status_code)
    declared = response.headers.get("Content-Length", "")
    if declared.isdigit():
        V.check_size(int(declared))
    data = b""
    for chunk in response.iter_content(8192):
        data += chunk
        V.check_size(len(data))
    return parse_text(V.check_content(data), url, URL_ORDER, guess_format(response.headers.get("Content-Type")))
