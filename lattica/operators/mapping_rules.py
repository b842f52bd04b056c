"""The mapping rules of process models: fixed values, a row each, in the order of the two rule files.

(name, path of the elements, subject, class, pairs of predicate and value). See `mapping` for what paths and values say.
"""

#: Fixed values.
RULES = (
    ("ProcessMapping", "definitions/process", "~{@id}", "bbo:Process", (("org:belongsToRAMILayer", "<layer:Business>"), ("bbo:name", "@name"), ("org:belongsToView", "<org:BusinessProcessManagementView>"),)),
    ("SubProcessMapping", "definitions/process/subProcess", "~{@id}", "bbo:SubProcess", (("org:belongsToRAMILayer", "<layer:Business>"), ("org:belongsToView", "<org:BusinessProcessManagementView>"),)),
    ("ProcessErrorMapping", "definitions/error", "~{@id}", "bbo:Error", (("bbo:name", "@name"),)),
    ("ProcessPropertyMapping", "definitions/process//property", "~{@id}", "bbo:Property", (("bbo:name", "@name"), ("bbo:has_property_element", "<{../@id}>"),)),
    ("ProcessStartEventMapping", "definitions/process/startEvent", "~{@id}", "bbo:StartEvent", (("bbo:has_targetRef", "<~{*}>"), ("org:belongsToProcess", "^ProcessMapping all"), ("bbo:name", "@name"),)),
    ("ProcessEndEventMapping", "definitions/process/endEvent", "~{@id}", "bbo:EndEvent", (("org:belongsToProcess", "^ProcessMapping all"), ("bbo:name", "@name"),)),
    ("ProcessBoundaryEventMapping", "definitions/process/boundaryEvent", "~{@id}", "bbo:BoundaryEvent", (("bbo:attachedToRef", "<{@attachedToRef}>"), ("bbo:name", "@name"), ("bbo:has_targetRef", "<{outgoing}>"), ("bbo:has_eventDefinition", "<{messageEventDefinition/@id}>"), ("bbo:has_eventDefinition", "<{errorEventDefinition/@id}>"),)),
    ("ProcessErrorEventDefinitionMapping", "//errorEventDefinition", "~{@id}", "bbo:ErrorEventDefinition", (("org:belongsToProcess", "^ProcessMapping all"),)),
    ("ProcessMessageEventDefinitionMapping", "//messageEventDefinition", "~{@id}", "bbo:MessageEventDefinition", (("org:belongsToProcess", "^ProcessMapping all"),)),
    ("ProcessIntermediateThrowMapping", "definitions/process//intermediateThrowEvent", "~{@id}", "bbo:IntermediateThrowEvent", (("org:belongsToProcess", "^ProcessMapping all"), ("bbo:name", "@name"), ("bbo:has_targetRef", "<~{outgoing}>"), ("bbo:has_sourceRef", "<~{incoming}>"), ("bbo:has_eventDefinition", "<~{messageEventDefinition}>"),)),
    ("ProcessSequenceFlowMapping", "definitions/process/sequenceFlow", "~{@id}", "bbo:sequenceFlow", (("org:belongsToProcess", "^ProcessMapping all"), ("bbo:name", "@name"), ("bbo:has_sourceRef", "<~{@sourceRef}>"), ("bbo:has_targetRef", "<~{@targetRef}>"), ("bbo:condition", "^ProcessSequenceFlowConditionExpressionMapping child"),)),
    ("ProcessSequenceFlowConditionExpressionMapping", "definitions/process/sequenceFlow/conditionExpression", "~{../@id}/conditionExpression/{position()}", "bbo:conditionExpression", (("org:belongsToProcessSequenceFlow", "^ProcessSequenceFlowMapping parent"), ("bbo:xsi_type", "type()"), ("bbo:expression", "text()"),)),
    ("ProcessTaskMapping", "definitions/process//task", "~{@id}", "bbo:Task", (("bbo:name", "@name"), ("org:belongsToProcess", "^ProcessMapping all"),)),
    ("ProcessServiceTaskMapping", "definitions/process//serviceTask", "~{@id}", "bbo:ServiceTask", (("bbo:name", "@name"), ("org:belongsToProcess", "^ProcessMapping all"),)),
    ("ProcessUserTaskMapping", "definitions/process//userTask", "~{@id}", "bbo:UserTask", (("bbo:name", "@name"), ("org:belongsToProcess", "^ProcessMapping all"),)),
    ("ProcessManualTask", "definitions/process//manualTask", "~{@id}", "bbo:ManualTask", (("bbo:name", "@name"), ("org:belongsToProcess", "^ProcessMapping all"),)),
    ("ProcessSendTaskMapping", "definitions/process//sendTask", "~{@id}", "bbo:SendTask", (("bbo:name", "@name"), ("org:belongsToProcess", "^ProcessMapping all"),)),
    ("ProcessReceiveTaskMapping", "definitions/process//receiveTask", "~{@id}", "bbo:ReceiveTask", (("bbo:name", "@name"), ("org:belongsToProcess", "^ProcessMapping all"),)),
    ("ProcessBusinessRuleTaskMapping", "definitions/process//businessRuleTask", "~{@id}", "bbo:BusinessRuleTask", (("bbo:name", "@name"), ("org:belongsToProcess", "^ProcessMapping all"),)),
    ("ProcessScriptTaskMapping", "definitions/process//scriptTask", "~{@id}", "bbo:ScriptTask", (("bbo:name", "@name"), ("org:belongsToProcess", "^ProcessMapping all"),)),
    ("ProcessParallelGatewayMapping", "definitions/process/parallelGateway", "~{@id}", "bbo:ParallelGateway", (("bbo:DefaultSequenceFlow", "<{@default}>"), ("org:belongsToProcess", "^ProcessMapping all"), ("bbo:name", "@name"), ("bbo:has_targetRef", "<{outgoing}>"), ("bbo:has_sourceRef", "<{incoming}>"),)),
    ("ProcesseXlusiveORGatewayMapping", "definitions/process//exclusiveGateway", "~{@id}", "bbo:ExclusiveGateway", (("org:belongsToProcess", "^ProcessMapping all"), ("bbo:DefaultSequenceFlow", "<{@default}>"), ("bbo:name", "@name"), ("bbo:has_targetRef", "<{outgoing}>"), ("bbo:has_sourceRef", "<{incoming}>"),)),
    ("ProcessAssociationMapping", "definitions/process/association", "~{@id}", "ext:Association", (("org:belongsToProcess", "^ProcessMapping all"), ("bbo:has_sourceRef", "<~{@sourceRef}>"), ("bbo:has_targetRef", "<~{@targetRef}>"),)),
    ("ProcessTextAnnotationMapping", "definitions/process/textAnnotation", "~{@id}", "ext:TextAnnotation", (("org:belongsToProcess", "^ProcessMapping all"), ("rdfs:comment", "<{*}>"),)),
    ("ProcessDataObjectMapping", "definitions/process//dataObject", "~{@id}", "ext:DataObject", (("org:belongsToProcess", "^ProcessMapping all"),)),
    ("ProcessDataObjectReferenceMapping", "definitions/process//dataObjectReference", "~{@id}", "ext:DataObjectReference", (("bbo:name", "@name"), ("org:belongsToProcess", "^ProcessMapping all"), ("ext:dataObjectRef", "<~{@dataObjectRef}>"),)),
    ("ProcessDataOutputAssociationMapping", "definitions/process//dataOutputAssociation", "~{@id}", "ext:DataOutputAssociation", (("org:belongsToProcess", "^ProcessMapping all"), ("bbo:has_targetRef", "<~{targetRef}>"), ("ext:is_dataOutputFrom", "<{../@id}>"),)),
    ("ProcessDataInputAssociationMapping", "definitions/process//dataInputAssociation", "~{@id}", "ext:DataInputAssociation", (("org:belongsToProcess", "^ProcessMapping all"), ("bbo:has_sourceRef", "<~{sourceRef}>"), ("bbo:has_targetRef", "<~{targetRef}>"), ("ext:is_dataInputFor", "<{../@id}>"),)),
    ("ProcessDataStoreReferenceMapping", "definitions/process//dataStoreReference", "{@id}", "ext:DataStoreReference", (("org:belongsToProcess", "^ProcessMapping all"), ("bbo:name", "@name"),)),
    ("ProcessPoolLikeCollaborationMapping", "definitions/process//collaboration", "~{@id}", "ext:Collaboration", (("org:belongsToProcess", "^ProcessMapping all"),)),
    ("ProcessLaneSetMapping", "definitions/process/laneSet", "~{@id}", "ext:LaneSet", (("org:belongsToProcess", "^ProcessMapping all"),)),
    ("ProcessLaneMapping", "definitions/process/laneSet/lane", "~{@id}", "ext:Lane", (("org:belongsToProcess", "^ProcessMapping all"), ("bbo:has_activity", "<~{*}>"), ("bbo:name", "@name"),)),
    ("ProcessParticipantMapping", "definitions/process//collaboration/participant", "~{@id}", "ext:Participant", (("org:belongsToProcess", "^ProcessMapping all"), ("bbo:name", "@name"), ("ext:processRef", "<{@processRef}>"),)),
    ("ProcessMessageFlowMapping", "definitions/process/collaboration/messageFlow", "~{@id}", "ext:MessageFlow", (("org:belongsToProcess", "^ProcessMapping all"), ("bbo:name", "@name"), ("bbo:has_sourceRef", "<~{@sourceRef}>"), ("bbo:has_targetRef", "<~{@targetRef}>"),)),
    ("CollaborationAssociationMapping", "definitions//collaboration/association", "~{@id}", "ext:Association", (("org:belongsToCollaboration", "^CollaborationMapping parent"), ("bbo:id", "@id"), ("ext:associationDirection", "@associationDirection"), ("bbo:sourceRef", "@sourceRef"), ("bbo:targetRef", "@targetRef"),)),
    ("ChoreographyAssociationMapping", "definitions//choreography/association", "~{@id}", "ext:Association", (("org:belongsToChoreography", "^ChoreographyMapping parent"), ("bbo:id", "@id"), ("ext:associationDirection", "@associationDirection"), ("bbo:sourceRef", "@sourceRef"), ("bbo:targetRef", "@targetRef"),)),
    ("CategoryMapping", "definitions/category", "~{@id}", "ext:Category", (("org:belongsToDefinitions", "^DefinitionsMapping parent"),)),
    ("CategoryCategoryValueMapping", "definitions/category/categoryValue", "~{@id}", "ext:CategoryValue", (("org:belongsToCategory", "^CategoryMapping parent"), ("bbo:name", "@value"),)),
    ("ParticipantCategoryValueRefMapping", "definitions//participant/categoryValueRef", "~{../@id}/categoryValueRef/{position()}", "ext:CategoryValueRef", (("org:belongsToParticipant", "^ParticipantMapping parent"), ("ext:categoryValueRef", "<{text()}>"),)),
    ("SequenceFlowCategoryValueRefMapping", "definitions//sequenceFlow/categoryValueRef", "~{../@id}/categoryValueRef/{position()}", "ext:CategoryValueRef", (("org:belongsToChoreographySequenceFlow", "^ChoreographySequenceFlowMapping parent"), ("ext:categoryValueRef", "<{text()}>"),)),
    ("ChoreographyTaskCategoryValueRefMapping", "definitions//choreographyTask/categoryValueRef", "~{../@id}/categoryValueRef/{position()}", "ext:CategoryValueRef", (("org:belongsToChoreographyTask", "^ChoreographyTaskMapping parent"), ("ext:categoryValueRef", "<{text()}>"),)),
    ("ParallelGatewayCategoryValueRefMapping", "definitions//parallelGateway/categoryValueRef", "~{../@id}/categoryValueRef/{position()}", "ext:CategoryValueRef", (("org:belongsToChoreographyParallelGateway", "^ChoreographyParallelGatewayMapping parent"), ("ext:categoryValueRef", "<{text()}>"),)),
    ("EndEventCategoryValueRefMapping", "definitions//endEvent/categoryValueRef", "~{../@id}/categoryValueRef/{position()}", "ext:CategoryValueRef", (("org:belongsToChoreographyEndEvent", "^ChoreographyEndEventMapping parent"), ("ext:categoryValueRef", "<{text()}>"),)),
    ("ExclusiveGatewayCategoryValueRefMapping", "definitions//exclusiveGateway/categoryValueRef", "~{../@id}/categoryValueRef/{position()}", "ext:CategoryValueRef", (("org:belongsToChoreographyExclusiveGateway", "^ChoreographyExclusiveGatewayMapping parent"), ("ext:categoryValueRef", "<{text()}>"),)),
    ("ChoreographyMapping", "definitions/choreography", "~{@id}", "ext:Choreography", (("org:belongsToDefinitions", "^DefinitionsMapping parent"), ("bbo:name", "@name"), ("ext:isClosed", "@isClosed"),)),
    ("ChoreographyChoreographyTaskMapping", "definitions/choreography/choreographyTask", "~{@id}", "ext:ChoreographyTask", (("org:belongsToChoreography", "^ChoreographyMapping parent"), ("bbo:name", "@name"), ("ext:initiatingParticipantRef", "@initiatingParticipantRef"), ("ext:loopType", "@loopType"),)),
    ("CollaborationMapping", "definitions/collaboration", "~{@id}", "ext:Collaboration", (("org:belongsToDefinitions", "^DefinitionsMapping parent"),)),
    ("DefinitionsMapping", "definitions", "~{@id}", "ext:Definitions", (("bbo:name", "@name"), ("ext:exporter", "@exporter"), ("ext:exporterVersion", "@exporterVersion"), ("ext:expressionLanguage", "@expressionLanguage"), ("ext:schemaLocation", "@schemaLocation"), ("ext:targetNamespace", "@targetNamespace"), ("ext:typeLanguage", "@typeLanguage"),)),
    ("ChoreographyEndEventMapping", "definitions/choreography/endEvent", "~{@id}", "ext:EndEvent", (("org:belongsToChoreography", "^ChoreographyMapping parent"), ("bbo:name", "@name"),)),
    ("ChoreographyEventBasedGatewayMapping", "definitions/choreography/eventBasedGateway", "~{@id}", "ext:EventBasedGateway", (("org:belongsToChoreography", "^ChoreographyMapping parent"), ("bbo:name", "@name"), ("ext:eventGatewayType", "@eventGatewayType"), ("ext:gatewayDirection", "@gatewayDirection"), ("ext:instantiate", "@instantiate"),)),
    ("ChoreographyExclusiveGatewayMapping", "definitions/choreography/exclusiveGateway", "~{@id}", "ext:ExclusiveGateway", (("org:belongsToChoreography", "^ChoreographyMapping parent"), ("bbo:name", "@name"), ("ext:default", "@default"), ("ext:gatewayDirection", "@gatewayDirection"),)),
    ("ChoreographyGroupMapping", "definitions/choreography/group", "~{@id}", "ext:Group", (("org:belongsToChoreography", "^ChoreographyMapping parent"), ("ext:categoryValueRef", "@categoryValueRef"),)),
    ("ChoreographyTaskIncomingMapping", "definitions//choreographyTask/incoming", "~{../@id}/incoming/{position()}", "ext:Incoming", (("org:belongsToChoreographyChoreographyTask", "^ChoreographyChoreographyTaskMapping parent"), ("ext:incoming", "<{text()}>"),)),
    ("ExclusiveGatewayIncomingMapping", "definitions//exclusiveGateway/incoming", "~{../@id}/incoming/{position()}", "ext:Incoming", (("org:belongsToChoreographyExclusiveGateway", "^ChoreographyExclusiveGatewayMapping parent"), ("ext:incoming", "<{text()}>"),)),
    ("EndEventIncomingMapping", "definitions//endEvent/incoming", "~{../@id}/incoming/{position()}", "ext:Incoming", (("org:belongsToChoreographyEndEvent", "^ChoreographyEndEventMapping parent"), ("ext:incoming", "<{text()}>"),)),
    ("ParallelGatewayIncomingMapping", "definitions//parallelGateway/incoming", "~{../@id}/incoming/{position()}", "ext:Incoming", (("org:belongsToChoreographyParallelGateway", "^ChoreographyParallelGatewayMapping parent"), ("ext:incoming", "<{text()}>"),)),
    ("EventBasedGatewayIncomingMapping", "definitions//eventBasedGateway/incoming", "~{../@id}/incoming/{position()}", "ext:Incoming", (("org:belongsToChoreographyEventBasedGateway", "^ChoreographyEventBasedGatewayMapping parent"), ("ext:incoming", "<{text()}>"),)),
    ("ChoreographyIntermediateCatchEventMapping", "definitions/choreography/intermediateCatchEvent", "~{@id}", "ext:IntermediateCatchEvent", (("org:belongsToChoreography", "^ChoreographyMapping parent"), ("bbo:name", "@name"),)),
    ("MessageMapping", "definitions/message", "~{@id}", "ext:Message", (("org:belongsToDefinitions", "^DefinitionsMapping parent"), ("bbo:name", "@name"),)),
    ("ChoreographyMessageFlowMapping", "definitions/choreography/messageFlow", "~{@id}", "ext:MessageFlow", (("org:belongsToChoreography", "^ChoreographyMapping parent"), ("ext:messageRef", "@messageRef"), ("ext:sourceRef", "@sourceRef"), ("ext:targetRef", "@targetRef"),)),
    ("ChoreographyTaskMessageFlowRefMapping", "definitions/choreography/choreographyTask/messageFlowRef", "~{../@id}/messageFlowRef/{position()}", "ext:MessageFlowRef", (("org:belongsToChoreographyChoreographyTask", "^ChoreographyChoreographyTaskMapping parent"), ("ext:messageFlowRef", "<{text()}>"),)),
    ("ChoreographyTaskOutgoingMapping", "definitions//choreographyTask/outgoing", "~{../@id}/outgoing/{position()}", "ext:Outgoing", (("org:belongsToChoreographyChoreographyTask", "^ChoreographyChoreographyTaskMapping parent"), ("ext:outgoing", "<{text()}>"),)),
    ("ExclusiveGatewayOutgoingMapping", "definitions//exclusiveGateway/outgoing", "~{../@id}/outgoing/{position()}", "ext:Outgoing", (("org:belongsToChoreographyExclusiveGateway", "^ChoreographyExclusiveGatewayMapping parent"), ("ext:outgoing", "<{text()}>"),)),
    ("StartEventOutgoingMapping", "definitions//startEvent/outgoing", "~{../@id}/outgoing/{position()}", "ext:Outgoing", (("org:belongsToChoreographyStartEvent", "^ChoreographyStartEventMapping parent"), ("ext:outgoing", "<{text()}>"),)),
    ("ParallelGatewayOutgoingMapping", "definitions//parallelGateway/outgoing", "~{../@id}/outgoing/{position()}", "ext:Outgoing", (("org:belongsToChoreographyParallelGateway", "^ChoreographyParallelGatewayMapping parent"), ("ext:outgoing", "<{text()}>"),)),
    ("EventBasedGatewayOutgoingMapping", "definitions//eventBasedGateway/outgoing", "~{../@id}/outgoing/{position()}", "ext:Outgoing", (("org:belongsToChoreographyEventBasedGateway", "^ChoreographyEventBasedGatewayMapping parent"), ("ext:outgoing", "<{text()}>"),)),
    ("IntermediateCatchEventOutgoingMapping", "definitions//intermediateCatchEvent/outgoing", "~{../@id}/outgoing/{position()}", "ext:Outgoing", (("org:belongsToChoreographyIntermediateCatchEvent", "^ChoreographyIntermediateCatchEventMapping parent"), ("ext:outgoing", "<{text()}>"),)),
    ("ChoreographyParallelGatewayMapping", "definitions/choreography/parallelGateway", "~{@id}", "ext:ParallelGateway", (("org:belongsToChoreography", "^ChoreographyMapping parent"), ("bbo:name", "@name"), ("ext:gatewayDirection", "@gatewayDirection"),)),
    ("ChoreographyParticipantMapping", "definitions/choreography/participant", "~{@id}", "ext:Participant", (("org:belongsToChoreography", "^ChoreographyMapping parent"), ("bbo:name", "@name"),)),
    ("ParticipantParticipantMultiplicityMapping", "definitions/choreography/participant/participantMultiplicity", "~{@id}", "ext:ParticipantMultiplicity", (("org:belongsToChoreographyParticipant", "^ChoreographyParticipantMapping parent"), ("ext:minimum", "@minimum"), ("ext:maximum", "@maximum"),)),
    ("ChoreographyTaskParticipantRefMapping", "definitions/choreography/choreographyTask/participantRef", "~{../@id}/participantRef/{position()}", "ext:ParticipantRef", (("org:belongsToChoreographyChoreographyTask", "^ChoreographyChoreographyTaskMapping parent"), ("ext:participantRef", "<{text()}>"),)),
    ("ChoreographySequenceFlowMapping", "definitions/choreography/sequenceFlow", "~{@id}", "bbo:SequenceFlow", (("bbo:has_sourceRef", "<~{@sourceRef}>"), ("bbo:has_targetRef", "<~{@targetRef}>"), ("org:belongsToChoreography", "^ChoreographyMapping all"), ("bbo:condition", "^ChoreographySequenceFlowConditionExpressionMapping child"), ("ext:isImmediate", "@isImmediate"), ("bbo:name", "@name"),)),
    ("ChoreographySequenceFlowConditionExpressionMapping", "definitions/choreography/sequenceFlow/conditionExpression", "~{../@id}/conditionExpression/{position()}", "bbo:conditionExpression", (("bbo:xsi_type", "type()"), ("bbo:expression", "text()"), ("org:belongsToChoreographySequenceFlow", "^ChoreographySequenceFlowMapping parent"),)),
    ("StartEventSignalEventDefinitionMapping", "definitions/choreography/startEvent/signalEventDefinition", "~{@id}", "ext:SignalEventDefinition", (("org:belongsToChoreographyStartEvent", "^ChoreographyStartEventMapping parent"),)),
    ("ChoreographyStartEventMapping", "definitions/choreography/startEvent", "~{@id}", "ext:StartEvent", (("org:belongsToChoreography", "^ChoreographyMapping parent"), ("bbo:name", "@name"), ("ext:isInterrupting", "@isInterrupting"),)),
    ("EndEventTerminateEventDefinitionMapping", "definitions/choreography/endEvent/terminateEventDefinition", "~{@id}", "ext:TerminateEventDefinition", (("org:belongsToChoreographyEndEvent", "^ChoreographyEndEventMapping parent"),)),
    ("CollaborationTextAnnotationTextMapping", "definitions/collaboration/textAnnotation/text", "~{../@id}/text/{position()}", "ext:Text", (("org:belongsToCollaborationTextAnnotation", "^CollaborationTextAnnotationMapping parent"), ("ext:text", "<{text()}>"),)),
    ("ChoreographyTextAnnotationTextMapping", "definitions/choreography/textAnnotation/text", "~{../@id}/text/{position()}", "ext:Text", (("org:belongsToChoreographyTextAnnotation", "^ChoreographyTextAnnotationMapping parent"), ("ext:text", "<{text()}>"),)),
    ("CollaborationTextAnnotationMapping", "definitions//collaboration/textAnnotation", "~{@id}", "ext:TextAnnotation", (("org:belongsToCollaboration", "^CollaborationMapping parent"), ("bbo:id", "@id"), ("ext:alignment", "@alignment"), ("ext:textFormat", "@textFormat"),)),
    ("ChoreographyTextAnnotationMapping", "definitions//choreography/textAnnotation", "~{@id}", "ext:TextAnnotation", (("org:belongsToChoreography", "^ChoreographyMapping parent"), ("bbo:id", "@id"), ("ext:alignment", "@alignment"), ("ext:textFormat", "@textFormat"),)),
    ("StartEventTimerEventDefinitionMapping", "definitions//startEvent/timerEventDefinition", "~{@id}", "ext:TimerEventDefinition", (("org:belongsToChoreographyStartEvent", "^ChoreographyStartEventMapping parent"), ("bbo:id", "@id"),)),
    ("IntermediateCatchEventTimerEventDefinitionMapping", "definitions//intermediateCatchEvent/timerEventDefinition", "~{@id}", "ext:TimerEventDefinition", (("org:belongsToChoreographyIntermediateCatchEvent", "^ChoreographyIntermediateCatchEventMapping parent"), ("bbo:id", "@id"),)),
)
