"""Named ends of channels between pipes: each end is taken once, and who took it tells who depends on whom."""

from __future__ import annotations

from ..errors import ChannelError


class ChannelNames:
    def __init__(self) -> None:
        self.senders: dict[str, int] = {}
        self.receivers: dict[str, int] = {}
        self.owner: int | None = None

    def acquire_sender(self, name: str) -> None:
        self._acquire(self.senders, name, "sender")

    def acquire_receiver(self, name: str) -> None:
        self._acquire(self.receivers, name, "receiver")

    def _acquire(self, taken: dict[str, int], name: str, what: str) -> None:
        if self.owner is None:
            raise ChannelError("no owner set")
        if name in taken:
            raise ChannelError(f"{what} {name!r} already acquired")
        taken[name] = self.owner

    def remaining_senders(self) -> set[str]:
        return self.receivers.keys() - self.senders.keys()

    def remaining_receivers(self) -> set[str]:
        return self.senders.keys() - self.receivers.keys()

    def dependencies(self) -> set[tuple[int, int]]:
        """(receiver, sender) of each channel; an end without the other is an error."""
        if half := self.remaining_senders() | self.remaining_receivers():
            raise ChannelError(f"only one end acquired: {', '.join(sorted(half))}")
        return {(self.receivers[n], self.senders[n]) for n in self.senders}
