"""A deterministic stand-in for the hosted model, for tests and the P3/V1/E7 queries.

Replies and failures follow from the length and the first words of the request
text, so the oracle can state them in SQL.
"""

from __future__ import annotations

import json

from palaver.operators.completion import CompletionError


def stub_client_factory():
    def client(system_prompt: str, user_content: str, max_tokens: int, temperature: float) -> dict:
        h = len(user_content)
        if h % 97 == 0:
            raise CompletionError("timeout", "read timed out")
        if h % 89 == 0:
            raise CompletionError("api_error", "This model's maximum context length is 8192 tokens")
        if h % 83 == 0:
            raise CompletionError("rate_limit", "slow down")
        body = user_content.rsplit("\nTranscript: ", 1)[-1]
        words = body.replace("\n", " ").split(" ")
        if system_prompt.startswith("Summarise"):
            choices = [" ".join(words[:30])]
        elif system_prompt.startswith("Read the transcript"):
            reply = {"conversation_type": "CASUAL" if h % 2 else "FORMAL",
                     "topics": [{"name": words[0], "confidence_score": 0.5}],
                     "key_points": [" ".join(words[:8])]}
            text = json.dumps(reply, ensure_ascii=False, separators=(",", ":"))
            choices = ["```json\n" + text + "\n```" if h % 3 else text]
        else:
            unsafe = "@" in body
            choices = [json.dumps({"is_safe": not unsafe, "reject_reason": "PII" if unsafe else None},
                                  separators=(",", ":"))]
        return {"choices": choices, "prompt_tokens": h // 4,
                "completion_tokens": sum(len(c) for c in choices) // 4, "model": "stub-1"}
    return client
