"""Running a job's work so that it can be watched and cancelled."""

from __future__ import annotations

import threading
import uuid

from pyspark import InheritableThread
from pyspark.sql import SparkSession

POLL_SECONDS = 0.2


class Cancelled(Exception):
    """The caller asked for an end."""


def run(spark: SparkSession, work, should_cancel=None, progress=None):
    """``work()``; meanwhile ``progress(done, total)`` gets the tasks of its jobs and ``should_cancel()`` is asked again and again.

    If that is true, all jobs that ``work`` began are cancelled and ``Cancelled`` is raised; what it wrote so far counts only
    once it is committed, so nothing changes.
    """
    if should_cancel is None and progress is None:
        return work()
    context, tag, out = spark.sparkContext, f"foliant-{uuid.uuid4().hex}", {}

    def tagged():
        context.addJobTag(tag)
        try:
            out["made"] = work()
        except BaseException as error:  # noqa: BLE001  handed on below
            out["error"] = error

    thread = InheritableThread(target=tagged)
    thread.start()
    stopped = False
    while thread.is_alive():
        if not stopped and should_cancel is not None and should_cancel():
            stopped = True
        if stopped:
            context.cancelJobsWithTag(tag)  # again for jobs that began since
        if progress is not None:
            progress(*_tasks(context, tag))
        thread.join(POLL_SECONDS)
    if stopped:
        raise Cancelled
    if "error" in out:
        raise out["error"]
    return out["made"]


def _tasks(context, tag: str) -> tuple[int, int]:
    """(done, all) tasks of the jobs under a tag."""
    done = total = 0
    tracker = context.statusTracker()
    for job in context._jsc.sc().statusTracker().getJobIdsForTag(tag):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            about = tracker.getStageInfo(stage)
            if about:
                done, total = done + about.numCompletedTasks, total + about.numTasks
    return done, total


class Latest:
    """Requests of which only the newest counts: a newer one cancels the one that runs and begins when that has ended.

    ``submit(work)`` runs ``work(should_cancel)`` in the caller's thread; requests that a newer one overtook while they waited
    raise ``Cancelled`` without having begun.
    """

    def __init__(self):
        self.newest, self._count, self._turn = 0, threading.Lock(), threading.Lock()

    def submit(self, work):
        with self._count:
            self.newest += 1
            mine = self.newest
        with self._turn:
            if mine != self.newest:
                raise Cancelled
            return work(lambda: mine != self.newest)
