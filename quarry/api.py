"""The HTTP surface: POST /sql/ with {query, limit, offset}. handle() is the endpoint without a server."""

from __future__ import annotations

from quarry.session import Session


def handle(session: Session, body: dict) -> dict:
    return session.run_page(body["query"], int(body["limit"]), int(body["offset"]))


def create_app(session: Session):
    """A web application, where the optional web framework is installed."""
    from fastapi import Body, FastAPI

    app = FastAPI()

    @app.post("/sql/")
    def sql(body: dict = Body(...)):  # noqa: B008
        return handle(session, body)

    return app
