"""Ticket state handler for ``transformWithStateInPandas``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = (
    "close_at bigint, close_seq bigint, close_action string, open_at bigint, open_seq bigint, events bigint"
)
NEVER = -(2**63)


def ticket_processor(statuses: dict[str, str]) -> StatefulProcessor:
    """Handler over rows (entity, at, seq, action); ``statuses`` maps each action but ``open``."""

    closing = [action for action in statuses if action != "open"]

    class TicketState(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("ticket", STATE)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            known = self.state.get() if self.state.exists() else (NEVER, NEVER, "", NEVER, NEVER, 0)
            close, opened, events = (known[0], known[1], known[2]), (known[3], known[4]), known[5]
            for frame in rows:
                events += len(frame)
                for mine, opens in ((frame["action"] == "open", True), (frame["action"].isin(closing), False)):
                    part = frame[mine]
                    if len(part):  # the newest row of the frame is enough
                        late = part[part["at"] == part["at"].max()]
                        late = late[late["seq"] == late["seq"].max()]
                        at, seq, action = int(late["at"].iloc[0]), int(late["seq"].iloc[0]), late["action"].max()
                        if opens:
                            opened = max(opened, (at, seq))
                        else:
                            close = max(close, (at, seq, action))
            self.state.update((*close, *opened, events))
            status = statuses.get(close[2], "open")
            if opened > close[:2] and status != "assigned":
                status = "open"
            yield pd.DataFrame({"entity": [key[0]], "status": [status], "events": [events]})

        def close(self) -> None:
            pass

    return TicketState()
