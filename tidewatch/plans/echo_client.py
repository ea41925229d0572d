"""A stand-in for a text model, so that generation can be checked: it reads the prompt back."""

from __future__ import annotations

import json


class PanelEcho:
    """Repeats the first panel decision. Prompts whose length is a multiple of five get an unusable first reply."""

    def __init__(self) -> None:
        self._failed: set[tuple[str, str]] = set()

    def generate(self, model: str, requests: list[list[dict]]) -> list[str]:
        return [self._reply(model, messages) for messages in requests]

    def _reply(self, model: str, messages: list[dict]) -> str:
        content = messages[-1]["content"]
        prompt = content if isinstance(content, str) else content[0]["text"]
        if len(prompt) % 5 == 0 and (model, prompt) not in self._failed:
            self._failed.add((model, prompt))
            return "Let me think about this customer."
        self._failed.discard((model, prompt))
        line = next((x for x in prompt.splitlines() if x.strip().startswith("Prediction")), ":")
        decision = line.rsplit(":", 1)[1].strip().lower()
        return json.dumps(
            {
                "decision": decision,
                "explanation": f"The first panel member predicts {decision}.",
                "recommendation": "Follow the panel.",
            }
        )


class BreaksDown(PanelEcho):
    """Fails for good on prompts whose length is a multiple of eleven, as a server that goes away."""

    def generate(self, model: str, requests: list[list[dict]]) -> list[str]:
        if any(len(messages[-1]["content"]) % 11 == 0 for messages in requests):
            raise ConnectionError("the server is gone")
        return super().generate(model, requests)
