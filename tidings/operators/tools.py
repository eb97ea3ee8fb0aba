"""Tool definitions sent with every chat request (O36).

Fixed values: the three tool definitions of the reference, as data.  They
are serialised once with sorted keys and no spaces, as the reference's
JSON maps are.
"""

from __future__ import annotations

import json

TOOLS = [
    {
        "type": "function",
        "function": {
            "name": "reply_latest_story",
            "description": "Get the latest story from daily Hacker News RSS feed",
            "parameters": {
                "type": "object",
                "properties": {
                    "token": {
                        "type": "string",
                        "description": "Channel access tokens as a means of authentication for the channel"
                    },
                    "reply_token": {
                        "type": "string",
                        "description": "Reply token that is used when sending a reply message"
                    }
                },
                "required": [
                    "token",
                    "reply_token"
                ]
            }
        }
    },
    {
        "type": "function",
        "function": {
            "name": "push_summary",
            "description": "In the ChatGPT function call, push the selected news summary to the user by index (starting from 1, with a maximum index of 10). The index is passed as an array of integers, with a maximum array size of 5. If the array size exceeds 5, please return error without calling this function.",
            "parameters": {
                "type": "object",
                "properties": {
                    "indexes": {
                        "type": "array",
                        "description": "An array of integers, with a maximum array size of 5, representing the indices of news articles that will be sent to the user.",
                        "items": {
                            "type": "integer"
                        }
                    }
                },
                "required": [
                    "indexes"
                ]
            }
        }
    },
    {
        "type": "function",
        "function": {
            "name": "push_url_summary",
            "description": "In the ChatGPT function call, push the content summary to the user URL.",
            "parameters": {
                "type": "object",
                "properties": {
                    "url": {
                        "type": "string",
                        "description": "An URL of a web page, which content will be summarized and push the summary to user."
                    }
                },
                "required": [
                    "url"
                ]
            }
        }
    }
]

TOOLS_JSON = json.dumps(TOOLS, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
