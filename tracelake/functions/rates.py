"""Published model prices and the family names that stand in for unlisted models."""

from __future__ import annotations

# USD per million tokens, (prompt, completion).
MODEL_RATES: dict[str, tuple[str, str]] = {
    "gpt-6-astra": ("10", "50"),
    "gpt-6": ("10", "50"),
    "gpt-5.6-sol": ("4", "20"),
    "gpt-5.6": ("4", "20"),
    "gpt-5.6-terra": ("2", "12"),
    "gpt-5.6-luna": ("0.20", "1.20"),
    "gpt-5.5-pro": ("30", "180"),
    "gpt-5.5": ("5", "30"),
    "gpt-5.4-pro": ("15", "90"),
    "gpt-5.4": ("2.50", "15"),
    "gpt-5.4-mini": ("0.25", "2"),
    "gpt-5.4-nano": ("0.05", "0.40"),
    "gpt-5.3-codex": ("2", "12"),
    "gpt-5.2-pro": ("10.50", "84"),
    "gpt-5.2": ("1.75", "14"),
    "gpt-5.1": ("1.50", "12"),
    "gpt-5-pro": ("30", "180"),
    "gpt-5-mini": ("0.25", "2"),
    "gpt-5-nano": ("0.05", "0.40"),
    "gpt-5": ("5", "30"),
    "o3-pro": ("10", "40"),
    "o3": ("1", "4"),
    "o4-mini": ("1.10", "4.40"),
    "gpt-4.1-mini": ("0.40", "1.60"),
    "gpt-4.1": ("2", "8"),
    "gpt-4o": ("2.50", "10"),
    "gpt-4o-2024-11-20": ("2.50", "10"),
    "gpt-4o-2024-08-06": ("2.50", "10"),
    "gpt-4o-2024-05-13": ("5", "15"),
    "chatgpt-4o-latest": ("5", "15"),
    "gpt-4o-realtime-preview": ("5", "20"),
    "gpt-4o-realtime-preview-2024-12-17": ("5", "20"),
    "gpt-4o-realtime-preview-2024-10-01": ("5", "20"),
    "gpt-4o-mini": ("0.15", "0.60"),
    "gpt-4o-mini-2024-07-18": ("0.15", "0.60"),
    "gpt-4o-mini-realtime-preview": ("0.60", "2.40"),
    "gpt-4o-mini-realtime-preview-2024-12-17": ("0.60", "2.40"),
    "gpt-4.5": ("75", "150"),
    "gpt-4.5-preview": ("75", "150"),
    "gpt-4.5-preview-2025-02-27": ("75", "150"),
    "o1": ("15", "60"),
    "o1-2024-12-17": ("15", "60"),
    "o1-preview": ("15", "60"),
    "o1-mini": ("3", "12"),
    "o1-mini-2024-09-12": ("3", "12"),
    "o3-mini": ("1.10", "4.40"),
    "o3-mini-2025-01-31": ("1.10", "4.40"),
    "gpt-4-turbo": ("10", "30"),
    "gpt-4-turbo-2024-04-09": ("10", "30"),
    "gpt-4-turbo-preview": ("10", "30"),
    "gpt-4-0125-preview": ("10", "30"),
    "gpt-4-1106-preview": ("10", "30"),
    "gpt-4": ("30", "60"),
    "gpt-3.5-turbo": ("0.50", "1.50"),
    "gpt-3.5-turbo-0125": ("0.50", "1.50"),
    "gpt-3.5-turbo-instruct": ("1.50", "2"),
    "text-embedding-3-small": ("0.02", "0"),
    "text-embedding-3-large": ("0.13", "0"),
    "text-embedding-ada-002": ("0.10", "0"),
    "babbage-002": ("0.40", "0.40"),
    "davinci-002": ("2", "2"),
    "claude-3-7-sonnet": ("3", "15"),
    "claude-3-7-sonnet-20250219": ("3", "15"),
    "claude-3-5-sonnet": ("3", "15"),
    "claude-3-5-sonnet-20241022": ("3", "15"),
    "claude-3-5-sonnet-20240620": ("3", "15"),
    "claude-3-5-haiku": ("0.80", "4"),
    "claude-3-5-haiku-20241022": ("0.80", "4"),
    "claude-3-opus": ("15", "75"),
    "claude-3-sonnet": ("3", "15"),
    "claude-3-haiku": ("0.25", "1.25"),
    "gemini-1.5-pro": ("3.50", "10.50"),
    "gemini-1.5-pro-latest": ("3.50", "10.50"),
    "gemini-1.5-flash": ("0.075", "0.30"),
    "gemini-1.5-flash-latest": ("0.075", "0.30"),
    "gemini-1.5-flash-8b": ("0.0375", "0.15"),
    "gemini-2.0-flash": ("0.10", "0.40"),
    "gemini-2.0-flash-exp": ("0.10", "0.40"),
    "gemini-2.5-flash": ("0.15", "0.60"),
    "gemini-2.5-pro": ("3.50", "10.50"),
    "deepseek-chat": ("0.14", "0.28"),
    "deepseek-v3": ("0.14", "0.28"),
    "deepseek-reasoner": ("0.55", "2.19"),
    "deepseek-r1": ("0.55", "2.19"),
    "llama-3.3-70b": ("0.59", "0.79"),
    "llama-3.1-70b": ("0.59", "0.79"),
    "llama-3.1-8b": ("0.05", "0.08"),
    "llama-3-70b": ("0.70", "0.90"),
    "llama-3-8b": ("0.10", "0.10"),
    "mixtral-8x7b": ("0.24", "0.24"),
    "qwen-2.5-72b": ("0.35", "0.40"),
}

# USD per million cached prompt tokens.
CACHED_RATES: dict[str, str] = {
    "gpt-6-astra": "1",
    "gpt-6": "1",
    "gpt-5.6-sol": "0.40",
    "gpt-5.6": "0.40",
    "gpt-5.6-terra": "0.20",
    "gpt-5.6-luna": "0.02",
    "gpt-5.5-pro": "3",
    "gpt-5.5": "0.50",
    "gpt-5.4-pro": "1.50",
    "gpt-5.4": "0.25",
    "gpt-5.4-mini": "0.025",
    "gpt-5.4-nano": "0.005",
    "gpt-5.3-codex": "0.20",
    "gpt-5.2-pro": "1.05",
    "gpt-5.2": "0.175",
    "gpt-5.1": "0.15",
    "gpt-5-pro": "3",
    "gpt-5-mini": "0.025",
    "gpt-5-nano": "0.005",
    "gpt-5": "0.50",
    "o3-pro": "2.50",
    "o3": "0.25",
    "o4-mini": "0.275",
    "gpt-4.1-mini": "0.10",
    "gpt-4.1": "0.50",
    "gpt-4o": "1.25",
}

# For a model with no listed prefix, the first row whose words all occur in its name
# decides which listed model it is priced as.
FAMILIES: list[tuple[tuple[str, ...], str]] = [
    (("gpt-6",), "gpt-6-astra"),
    (("gpt-5.6-terra",), "gpt-5.6-terra"),
    (("gpt-5.6-luna",), "gpt-5.6-luna"),
    (("gpt-5.6",), "gpt-5.6"),
    (("gpt-5.5-pro",), "gpt-5.5-pro"),
    (("gpt-5.5",), "gpt-5.5"),
    (("gpt-5.4-pro",), "gpt-5.4-pro"),
    (("gpt-5.4-mini",), "gpt-5.4-mini"),
    (("gpt-5.4-nano",), "gpt-5.4-nano"),
    (("gpt-5.4",), "gpt-5.4"),
    (("gpt-5.3",), "gpt-5.3-codex"),
    (("gpt-5.2-pro",), "gpt-5.2-pro"),
    (("gpt-5.2",), "gpt-5.2"),
    (("gpt-5.1",), "gpt-5.1"),
    (("gpt-5-pro",), "gpt-5-pro"),
    (("gpt-5-nano",), "gpt-5-nano"),
    (("gpt-5-mini",), "gpt-5-mini"),
    (("gpt-5",), "gpt-5"),
    (("gpt-4.5",), "gpt-4.5"),
    (("gpt-4.1-mini",), "gpt-4.1-mini"),
    (("gpt-4.1",), "gpt-4.1"),
    (("realtime", "mini"), "gpt-4o-mini-realtime-preview"),
    (("realtime",), "gpt-4o-realtime-preview"),
    (("gpt-4o-mini",), "gpt-4o-mini"),
    (("gpt-4o",), "gpt-4o"),
    (("o4-mini",), "o4-mini"),
    (("o3-pro",), "o3-pro"),
    (("o3-mini",), "o3-mini"),
    (("o3",), "o3"),
    (("o1-mini",), "o1-mini"),
    (("o1",), "o1"),
    (("text-embedding-3-small",), "text-embedding-3-small"),
    (("text-embedding-3-large",), "text-embedding-3-large"),
    (("text-embedding-ada-002",), "text-embedding-ada-002"),
    (("gpt-4",), "gpt-4-turbo"),
    (("gpt-3.5",), "gpt-3.5-turbo"),
    (("claude-3-7-sonnet",), "claude-3-7-sonnet"),
    (("claude-3-5-sonnet",), "claude-3-5-sonnet"),
    (("claude-3-5-haiku",), "claude-3-5-haiku"),
    (("claude-3-opus",), "claude-3-opus"),
    (("claude-3-haiku",), "claude-3-haiku"),
    (("gemini-2.5-flash",), "gemini-2.5-flash"),
    (("gemini-2.0-flash",), "gemini-2.0-flash"),
    (("gemini-1.5-flash",), "gemini-1.5-flash"),
    (("gemini-1.5-pro",), "gemini-1.5-pro"),
    (("deepseek-reasoner",), "deepseek-reasoner"),
    (("deepseek-r1",), "deepseek-reasoner"),
    (("deepseek-chat",), "deepseek-chat"),
    (("deepseek-v3",), "deepseek-chat"),
]
